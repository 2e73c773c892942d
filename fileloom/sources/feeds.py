"""Change feeds as catalog changes: journal rows by their reason bits, watcher rows by their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileloom.functions.derive import last_component
from fileloom.operators import events
from fileloom.operators.folders import FolderNames, location_of
from fileloom.schema import CHANGES
from fileloom.sources.listing import numbered
from fileloom.sources.tables import cut

#: Reason bits.
CREATE_BIT, DELETE_BIT, RENAME_NEW_BIT = 0x100, 0x200, 0x2000
#: Places that rows of a batch ask for and that may be broadcast to the catalog (some 50 MB); more are joined by a shuffle.
ASKED_ROWS = 200_000
#: Ranges of seq that the rows of one place are dealt to.
PARTS = 64


def _change(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CHANGES.fields])


def journal_changes(rows: DataFrame) -> DataFrame:
    """A delete bit wins over a new name, that over a creation; rows with none of them are dropped. Batch or stream."""
    has = lambda bit: F.col("reason").bitwiseAND(bit) != 0
    kind = F.when(has(DELETE_BIT), "delete").when(has(RENAME_NEW_BIT), "rename").when(has(CREATE_BIT), "create")
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    created = lambda c: F.when(F.col("kind") == "create", c)
    named = lambda c: F.when(F.col("kind") != "delete", c)
    return _change(
        rows, seq=F.col("seq"), kind=F.col("kind"), id=F.col("file_id"), parent_id=created(F.col("parent_id")),
        name=named(F.col("filename")), path=named(F.col("path")), size=created(F.col("size")),
        modified=created(F.col("modified")), is_dir=created(F.col("is_dir")), attributes=created(F.lit(0)),
    )


def _in_parts(deeds: DataFrame, rows: DataFrame) -> DataFrame:
    """deeds with part: PARTS ranges of the rows' seq, so that the rows of a place that a batch names again and again are
    not in one task."""
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    part = F.lit(0) if low is None else ((F.col("seq") - low) * PARTS / F.lit(high - low + 1)).cast("int")
    return deeds.withColumn("part", part)


def _puts(rows: DataFrame) -> DataFrame:
    """For each creation and rename whose place is asked for later: taken, the seq of the next row that takes away what is
    there (a delete, or a rename of it), and id and dir of what a creation puts there. Within its part by a window, of
    the parts after by a window over their first takes."""
    none = ["cast(null as bigint) as id", "cast(null as boolean) as dir"]
    deeds = rows.where("kind in ('delete', 'rename')").selectExpr("at", "seq", "0 as turn", "seq as take", *none)
    deeds = deeds.union(rows.where("kind = 'rename'").selectExpr("new_at", "seq", "1", "cast(null as bigint)", *none))
    deeds = deeds.union(rows.where("kind = 'create'").selectExpr("at", "seq", "1", "cast(null as bigint)", "id", "coalesce(is_dir, false)"))
    deeds = _in_parts(deeds.where("at is not null"), rows)
    own = Window.partitionBy("at", "part").orderBy(F.desc("seq"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part of a place.
    parts = Window.partitionBy("at").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    later = deeds.groupBy("at", "part").agg(F.min("take").alias("first"))
    later = later.select("at", "part", F.min("first").over(parts).alias("later"))
    puts = deeds.withColumn("next", F.min("take").over(own)).where("take is null").join(later, ["at", "part"])
    return puts.select("seq", "id", "dir", F.coalesce("next", "later").alias("taken")).where("taken is not null")


def _there(puts: DataFrame, held: DataFrame) -> DataFrame:
    """seq of the rows at whose place something is.

    What a row puts somewhere is taken by one row, so the renames are a forest. At a row's place something is if the catalog
    (held) or a creation put it there, or a rename at whose own place something was: so are all rows that such a one leads
    to. They are marked by pointer doubling, over the renames alone that lead to a row of which it isn't known yet."""
    sure = cut(puts.where("id is not null").select(F.col("taken").alias("seq")).union(held.select("seq")).distinct())
    links = puts.where("id is null").select("seq", F.col("taken").alias("to"))
    links = links.join(sure.select(F.col("seq").alias("to")), "to", "left_anti")
    links = cut(links.join(sure.select("seq", F.lit(True).alias("live")), "seq", "left"))
    found = links.where("live").select("to").distinct()
    steps = links.where("live is null").select("seq", "to")
    while not steps.isEmpty():
        reached = steps.join(found.select(F.col("to").alias("seq")), "seq", "left_semi").select("to")
        found = cut(found.union(reached).distinct())
        steps = cut(steps.join(steps.select(F.col("seq").alias("to"), F.col("to").alias("next")), "to").select("seq", F.col("next").alias("to")))
    return sure.union(found.select("to"))


def _resolved(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows with id and dir of what each is about (whether it is a directory); rows that are about nothing are left out.
    Creations have their ids; held(seq, old): what the catalog has at the place of the first row that takes it."""
    puts = cut(_puts(rows))
    # A rename from where nothing is puts nothing anywhere.
    done = puts.where("id is not null").unionByName(puts.where("id is null").join(_there(puts, held), "seq", "left_semi"))
    last = done.groupBy(F.col("taken").alias("seq")).agg(F.max(F.struct("seq", "id", "dir")).alias("last"))
    own = lambda c: F.when(F.col("last").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"last.{c}")).alias(c)
    # from: the rename that put it there.
    asked = cut(last.join(held, "seq", "full_outer").select("seq", F.col("last.seq").alias("from"), own("id"), own("dir")))
    known = asked.where("id is not null").select("seq", "id", "dir")
    links = asked.where("id is null").selectExpr("seq", "`from`", "false as known")
    while not links.where("not known").isEmpty():
        step = links.selectExpr("seq as p_seq", "`from` as p_from", "known as p_known")
        links = links.join(step, F.col("from") == F.col("p_seq"), "left")
        links = cut(links.selectExpr("seq", "coalesce(p_from, `from`) as `from`", "known or coalesce(p_known, true) as known"))
    moved = links.select(F.col("seq").alias("m_seq"), "from").join(known, F.col("from") == F.col("seq")).select("m_seq", "id", "dir")
    created = rows.where("kind = 'create'").withColumn("dir", F.coalesce("is_dir", F.lit(False)))
    asking = rows.where("kind in ('delete', 'rename')").drop("id").join(known.union(moved), "seq")
    return cut(created.unionByName(asking))


def _as_changes(rows: DataFrame) -> DataFrame:
    made = lambda c: F.when(F.col("kind") == "create", c)
    path = F.when(F.col("kind") == "rename", F.col("new_path")).when(F.col("kind") == "create", F.col("path"))
    return _change(
        rows, seq=F.col("seq"), kind=F.col("kind"), id=F.col("id"), parent_id=F.lit(None), name=last_component(path),
        path=path, size=made(F.col("size")), modified=made(F.col("modified")),
        is_dir=made(F.col("is_dir")), attributes=made(F.lit(0)),
    )


def _renames(rows: DataFrame, wanted: str) -> list[tuple[int, str, str]]:
    """The first MOST_RENAMES renames of rows that are wanted, and one more if there are more."""
    found = rows.where("kind = 'rename' and path != new_path").where(wanted).select("seq", "path", "new_path")
    return [tuple(r) for r in found.orderBy("seq").limit(events.MOST_RENAMES + 1).collect()]


def _first_cover(names: FolderNames, rows: DataFrame, catalog: DataFrame) -> int | None:
    """The seq of the first rename onto a directory in which something is then: from there on a path may lead to either."""
    if not names.covered:
        return None
    spaces = rows.sparkSession.createDataFrame(names.covered, "cover long, space string")
    deeds = rows.where("kind != 'create'").selectExpr("at as place", "seq", "0 as turn", "false as there")
    puts = rows.where("kind = 'create'").selectExpr("at as place", "seq", "1 as turn", "true as there")
    puts = puts.union(rows.where("kind = 'rename'").selectExpr("new_at", "seq", "1", "true"))
    held = catalog.selectExpr("path as place", "cast(null as bigint) as seq").union(puts.select("place", "seq"))
    held = held.select("*", F.explode(events.folders(F.col("place"))).alias("space")).join(F.broadcast(spaces), "space")
    held = held.where("seq is null or seq < cover").select("cover", "place").distinct()
    since = deeds.union(puts).withColumnRenamed("place", "d_place")
    since = held.join(since, (F.col("place") == F.col("d_place")) & (F.col("seq") < F.col("cover")), "left")
    last = since.groupBy("cover", "place").agg(F.max_by("there", F.struct("seq", "turn")).alias("there"))
    return last.where("coalesce(there, true)").agg(F.min("cover")).first()[0]


def _placed(rows: DataFrame, names: FolderNames) -> DataFrame:
    """rows with the locations of their paths: the paths themselves where no directory is renamed."""
    if not names.inside:
        return rows.withColumns({"at": F.col("path"), "new_at": F.col("new_path")})
    shared = rows.sparkSession.sparkContext.broadcast(names)
    before = F.col("seq") - 1
    return cut(rows.withColumns({"at": location_of(shared, F.col("path"), before), "new_at": location_of(shared, F.col("new_path"), F.col("seq"))}))


def _held(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """seq, old: what the catalog has at a place, for the first row that takes it away."""
    first = cut(rows.where("kind in ('delete', 'rename')").groupBy("at").agg(F.min("seq").alias("seq")))
    first = F.broadcast(first) if first.count() <= ASKED_ROWS else first
    held = catalog.where("id is not null").select(F.col("path").alias("at"), "id", F.col("is_dir").alias("dir")).join(first, "at")
    return cut(held.groupBy("seq").agg(F.min(F.struct("id", "dir")).alias("old")))


def _piece(rows: DataFrame, catalog: DataFrame) -> tuple[DataFrame, int | None]:
    """The rows that do something, resolved, up to the seq at which the batch has to be cut (null: all of them)."""
    known, end = _renames(rows, "is_dir"), None
    while True:
        if len(known) > events.MOST_RENAMES:
            end = known[events.MOST_RENAMES - 1][0]
            known, rows = known[: events.MOST_RENAMES], rows.where(F.col("seq") <= end)
        names = FolderNames(known)
        placed = _placed(rows, names)
        found = _resolved(placed, _held(placed, catalog))
        dirs = _renames(found, "dir")
        if dirs == known:
            break
        known = dirs
    covered = _first_cover(names, found, catalog)
    end = covered if covered is not None else end
    return (found if end is None else found.where(F.col("seq") <= end)), end


def watcher_changes(rows: DataFrame, catalog: DataFrame, first_id: int) -> DataFrame:
    """Changes of a watcher batch: creations get the ids from first_id on in the order of seq; deletes and renames the id
    that is at their path then, or are dropped; modifications and renames to nowhere are dropped.

    Paths mean something else after each rename of a directory. They are translated to locations that stay (FolderNames)
    by the batch's directory renames, which are taken from the watcher's own marks first, and then from what was found at
    their paths, until both agree: one round more for each level of renamed directories that the watcher has not marked,
    however many renames there are. At a location, what is there is decided by the last earlier row that put something
    there (a creation, or a rename to it) or took it away, else by the catalog. Each row meets the next one that takes what
    it puts, once; which renames do nothing, and to which creation a file that is renamed again and again goes back, is
    then found by pointer doubling over the renames that it concerns. Of several catalog rows with a path the smallest id
    counts.

    The batch is cut, and what follows meets the catalog with all changes so far, only after MOST_RENAMES directory
    renames, and after a rename onto a directory in which something still is, where a path may lead to either."""
    rows = cut(rows.where("kind != 'modify' and (kind != 'rename' or new_path is not null)"))
    created = numbered(rows.where("kind = 'create'"), "seq", first_id)
    rows = cut(rows.where("kind != 'create'").withColumn("id", F.lit(None).cast("long")).unionByName(created))
    found = None
    while True:
        part, end = _piece(rows, catalog)
        part = _as_changes(part)
        found = part if found is None else found.unionByName(part)
        if end is None:
            return found
        catalog, rows = cut(events.apply_changes(catalog, cut(part))), rows.where(F.col("seq") > end)
