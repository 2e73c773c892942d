"""Catalogs from directory trees: listed level by level by the executors, or from a ready listing table."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from itertools import chain, islice

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileloom.schema import CATALOG, DIRECTORY
from fileloom.sources.tables import cut

#: Directories that are listed but not gone into; the last in any case of A-Z.
SKIPPED = [".git", ".svn", ".hg", "__pycache__", ".venv", "target"]
SKIPPED_ANY_CASE = "node_modules"
_ENTRIES = "parent_path string, path string, name string, size long, modified timestamp, is_dir boolean"


def is_skipped(name: str) -> bool:
    return name in SKIPPED or name.lower() == SKIPPED_ANY_CASE


#: Entries that are handed over at once, whatever a directory holds.
ENTRIES_AT_ONCE = 20_000
_NAMES = ["parent_path", "path", "name", "size", "modified", "is_dir"]


def _frames(entries: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while rows := list(islice(entries, ENTRIES_AT_ONCE)):
        yield pd.DataFrame(rows, columns=_NAMES).astype({"size": "int64", "is_dir": "bool"})


def _on_mount(folder: str) -> Iterator[tuple]:
    try:
        entries = os.scandir(folder)
    except PermissionError:
        return
    with entries:
        for e in entries:
            try:
                info = e.stat(follow_symlinks=False)
            except OSError:
                continue
            is_dir = stat.S_ISDIR(info.st_mode)
            when = datetime.fromtimestamp(max(info.st_mtime, 0), UTC)
            yield folder, e.path, e.name, 0 if is_dir else info.st_size, when, is_dir


class Store:
    """A file system by its root's URI, as each Python worker opens it. Paths are the root and what follows it, as names
    are: not encoded as in a URI."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.system, base = fs.FileSystem.from_uri(root)
        self.base = base.rstrip("/")

    def own(self, path: str) -> str:
        """The path as the file system knows it."""
        if path != self.root and not path.startswith(self.root + "/"):
            raise ValueError(f"{path} is not below {self.root}")
        return self.base + path[len(self.root) :]

    def entries(self, folder: str) -> Iterator[tuple]:
        own = self.own(folder) or "/"
        try:
            found = self.system.get_file_info(fs.FileSelector(own))
        except PermissionError:
            return
        for info in found:
            if info.type in (fs.FileType.NotFound, fs.FileType.Unknown):
                continue
            # A link is no directory of its own.
            is_dir = info.type == fs.FileType.Directory and not (self.system.type_name == "local" and os.path.islink(info.path))
            seconds = max((info.mtime_ns or 0) / 1e9, 0)
            size = 0 if is_dir or info.size is None else info.size
            yield folder, f"{folder.rstrip('/')}/{info.base_name}", info.base_name, size, datetime.fromtimestamp(seconds, UTC), is_dir


def _levels(spark: SparkSession, root: str, entries: Callable[[], Callable[[str], Iterator[tuple]]]) -> DataFrame:
    """Every entry below root. One round per level; a level's directories are spread over the tasks."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = entries()
        yield from _frames(chain.from_iterable(of(folder) for frame in frames for folder in frame["path"]))

    frontier, levels = spark.createDataFrame([(root,)], "path string"), None
    while True:
        # Names of one level: repartitioned so that each task gets a share of the directories.
        level = cut(frontier.repartition("path").mapInPandas(scan, _ENTRIES))
        if level.isEmpty():
            break
        levels = level if levels is None else levels.unionByName(level)
        low = F.lower("name")
        frontier = level.where("is_dir").where(~F.col("name").isin(SKIPPED) & (low != SKIPPED_ANY_CASE)).select("path")
    return levels if levels is not None else spark.createDataFrame([], _ENTRIES)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """parent_path and the file columns of every entry below root, a folder that every executor has. Directories that may
    not be read, and entries that can't be, are passed over."""
    return _levels(spark, root, lambda: _on_mount)


def list_store(spark: SparkSession, root: str) -> DataFrame:
    """list_tree's rows for a root in a store: a URI of a file system that pyarrow opens on the executors (file, s3, gs,
    abfs, hdfs). Names that begin with a dot or an underscore and empty folders are listed like any other; a folder that the
    store only implies has the time 0. Paths are the root and what follows it. Nothing is read of the files."""
    return _levels(spark, root.rstrip("/"), lambda: Store(root).entries)


def catalog_of_entries(entries: DataFrame, first_id: int = 1) -> DataFrame:
    """The catalog of list_tree's entries: ids from first_id on in the order of paths, parents by their paths (null
    for the root's own entries)."""
    ids = numbered(entries.select("path"), "path", first_id)
    rows = entries.join(ids, "path")
    parents = ids.select(F.col("path").alias("parent_path"), F.col("id").alias("parent_id"))
    attributes = F.when(F.col("is_dir"), DIRECTORY).otherwise(0)
    rows = rows.join(parents, "parent_path", "left").withColumn("attributes", attributes)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG.fields])


def numbered(df: DataFrame, key: str, first: int) -> DataFrame:
    """df with id: consecutive numbers in the order of key, by range partitions and their counts, not in one task."""
    # The number of a partition, and below it 33 bits of a row's place in it.
    place = F.monotonically_increasing_id()
    parts = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", place))
    parts = parts.withColumns({"_part": F.shiftright("_at", 33), "_n": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = parts.groupBy("_part").count()
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    rows = parts.join(F.broadcast(starts), "_part")
    return rows.withColumn("id", F.col("_start") + F.col("_n") + F.lit(first)).drop("_at", "_part", "_n", "_start")


def outside_skipped(listing: DataFrame, root: str) -> DataFrame:
    """Rows of a listing table (path) that are not below a skipped directory; a skipped directory's own row stays, and
    root may have such a name."""
    parts = F.split(F.substring(F.col("path"), len(root) + 1, 1 << 30), r"[\\/]+")
    between = F.slice(F.filter(parts, lambda p: p != ""), 1, F.greatest(F.size(F.filter(parts, lambda p: p != "")) - 1, F.lit(0)))
    return listing.where(~F.exists(between, lambda p: p.isin(SKIPPED) | (F.lower(p) == SKIPPED_ANY_CASE)))


def body_gate(catalog: DataFrame, roots: list[str], extensions: list[str], most: int = 33_554_432) -> DataFrame:
    """Catalog rows (with ext) whose body is to be read: files with one of the extensions, of at most so many bytes, in
    or below a content root. Roots are compared by whole components and by case."""
    return catalog.where(~F.col("is_dir") & F.col("ext").isin(extensions) & (F.col("size") <= most) & in_roots(roots))


def in_roots(roots: list[str]) -> Column:
    plain = lambda p: p.replace("/", "\\").rstrip("\\")
    path = F.regexp_replace(F.translate("path", "/", "\\"), r"\\+\z", "")
    found = F.lit(False)
    for root in map(plain, roots):
        found = found | (path == root) | path.startswith(root + "\\")
    return found
