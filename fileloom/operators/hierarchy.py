"""Full paths from parent links, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom import schema
from fileloom.functions.derive import filetime
from fileloom.sources.tables import cut

#: The index of a volume's root in the low bits of an id, and the links that are followed at most.
ROOT_INDEX, INDEX_BITS, MOST_LINKS = 5, 0xFFFFFFFFFFFF, 512


#: Levels of directories that are resolved one after the other, and rows of a level that are broadcast in bytes of paths.
LEVELS, BROADCAST_BYTES = 64, 32 * 1024 * 1024


def full_paths(nodes: DataFrame, root: str) -> DataFrame:
    """id, path for nodes(id, parent, name): the names from the root down, joined by backslashes. A chain ends at the
    root record, at an id that is not there, at a node with the name `` or `.`, after its own parent, or after
    MOST_LINKS names; what was found so far is put below the root.

    Directories (nodes that are someone's parent) are resolved level by level from the top: a level's paths, which are
    broadcast if they are few, meet the directories below them where these lie, however many there are under one parent, and
    each path is made once. What no chain of LEVELS directories reaches (deeper ones, and circles of parents) is resolved
    by doubling. Other nodes join their parent's path once at the end."""
    named = (
        F.coalesce(F.col("name") != "", F.lit(False)) & (F.col("name") != ".")
        & (F.col("id").bitwiseAND(INDEX_BITS) != ROOT_INDEX)
    )
    up = F.when(F.col("parent") != F.col("id"), F.col("parent"))
    # own: the node's name, null for one without; next: the node to go on with, null at the end.
    start = nodes.select("id", F.when(named, F.col("name")).alias("own"), F.when(named, up).alias("next"))
    parents = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    dirs = cut(start.join(parents, "id", "left_semi"))
    folder = root if root.endswith("\\") else root + "\\"
    # before: what stands before the name of a node below.
    below = lambda top: F.when(F.col("own").isNotNull(), F.concat(top, F.col("own"), F.lit("\\"))).otherwise(top).alias("before")
    known = dirs.select(F.col("id").alias("p_id"))
    tops = dirs.join(known, F.col("next") == F.col("p_id"), "left").where("p_id is null")
    level = cut(tops.select("id", below(F.lit(folder))))
    levels = [level]
    while not level.isEmpty() and len(levels) < LEVELS:
        level = cut(dirs.join(_few(level), F.col("next") == F.col("p_id")).select("id", below(F.col("p_before"))))
        levels.append(level)
    found = cut(reduce(DataFrame.union, levels))
    done = start.join(_few(found), F.col("next") == F.col("p_id"), "left")
    path = F.when(F.col("own").isNotNull(), F.concat(F.coalesce("p_before", F.lit(folder)), "own")).otherwise(F.lit(root))
    done = done.select("id", path.alias("path"))
    rest = cut(dirs.join(found.select("id"), "id", "left_anti").select("id"))
    if rest.isEmpty():
        return done
    under = start.join(rest.select(F.col("id").alias("next")), "next", "left_semi").select("id")
    odd = _doubled(start.join(rest.union(under).distinct(), "id", "left_semi"), dirs, folder)
    odd = cut(odd.select(F.col("id").alias("o_id"), F.col("path").alias("o_path")))
    return done.join(odd, F.col("id") == F.col("o_id"), "left").select("id", F.coalesce("o_path", "path").alias("path"))


def _doubled(rows: DataFrame, dirs: DataFrame, folder: str) -> DataFrame:
    """id, path of rows(id, own, next) by doubling the links that each directory has resolved, 9 times at most. names: from
    the node up; next: the node to go on with, null at the end."""
    names = F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array())
    rows, dirs = (df.select("id", names.alias("names"), "next") for df in (rows, dirs))
    rounds = 0
    while rounds < 9 and not dirs.where("next is not null").isEmpty():
        dirs = cut(_step(dirs, dirs))
        rounds += 1
    names = F.array_join(F.reverse(F.slice("names", 1, MOST_LINKS)), "\\")
    return _step(rows, dirs).select("id", F.concat(F.lit(folder), names).alias("path"))


def _few(level: DataFrame) -> DataFrame:
    """p_id, p_before, broadcast if they are few bytes."""
    size = level.agg(F.sum(F.octet_length("before") + 16)).first()[0] or 0
    level = level.select(F.col("id").alias("p_id"), F.col("before").alias("p_before"))
    return F.broadcast(level) if size <= BROADCAST_BYTES else level


def _step(rows: DataFrame, by: DataFrame) -> DataFrame:
    """Each row goes on by what its next node has resolved."""
    far = by.select(F.col("id").alias("f_id"), F.col("names").alias("f_names"), F.col("next").alias("f_next"))
    joined = rows.join(far, F.col("next") == F.col("f_id"), "left")
    names = F.concat("names", F.coalesce("f_names", F.array().cast("array<string>")))
    names = F.slice(names, 1, MOST_LINKS)  # a circle of parents ends as well
    return joined.select("id", names.alias("names"), F.when(F.size(names) < MOST_LINKS, F.col("f_next")).alias("next"))


def catalog_of_nodes(nodes: DataFrame, root: str) -> DataFrame:
    """The catalog of a volume: size 0, no parent for parent 0 and for the root record, times from file times."""
    nodes = nodes.withColumn("parent", F.when(F.col("parent") != 0, F.col("parent")))
    paths = full_paths(nodes.select("id", "parent", "name"), root)
    is_root = F.col("id").bitwiseAND(INDEX_BITS) == ROOT_INDEX
    rows = nodes.join(paths, "id").select(
        "id",
        F.when(~is_root, F.col("parent")).alias("parent_id"),
        "name",
        "path",
        F.expr("0L").alias("size"),
        filetime(F.col("filetime")).alias("modified"),
        (F.col("attributes").bitwiseAND(schema.DIRECTORY) != 0).alias("is_dir"),
        "attributes",
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.CATALOG.fields])
