"""A catalog that follows a stream of changes, in runs as of a log-structured merge. A micro-batch writes a run: the rows,
paths, bodies and postings that it adds, and the keys that it replaces or removes. Of every `fanout` runs of one size one
is made, so that there are few, and a change is written again once for each time that the runs grow by that factor;
the first run, the base, is merged with the others only when these have changed a part of it. So what is written follows
the changes, not the catalog.

A body has a key of its own that it keeps wherever its file goes: a table of paths says which body a path has, and a
renamed directory writes paths alone. Postings are of bodies' keys, are merged as they are, and no body is read or
tokenised twice.

A small file, written last, names the runs that readers take; those of the two latest such files are kept. A batch that is
run again writes its own run anew and changes nothing else; rows older than the last seq are dropped."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fileloom.functions.derive import with_derived
from fileloom.operators.events import apply_changes, directory_renames, rows_below
from fileloom.operators.postings import build_postings, write_postings
from fileloom.schema import BODIES, CATALOG
from fileloom.sources.tables import cut, scratch

KEYS = "kind string, key string, version long"
PATHS = "path string, body_key string, version long"
KEYED_BODIES, KEYED_POSTINGS = "body_key string, body string", "word string, body_key string"
#: Changed ids or paths of a batch that may be broadcast; more are joined by a shuffle.
PICK_ROWS = 500_000
#: The base is merged when this many times the changes since are as many as its rows.
REWRITE = 4


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= PICK_ROWS else df


@dataclass(frozen=True)
class Run:
    """Versions lo to hi; rows: those of its catalog and paths (of the base), or its keys."""

    lo: int
    hi: int
    rows: int
    tier: int = 0

    @property
    def name(self) -> str:
        return f"{self.lo}-{self.hi}"


class CatalogStore:
    """Versions of a catalog, of bodies and of their postings, under one folder that all executors reach. fanout: runs of
    one size that become one."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 8):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout

    # The pointer files, and what they keep.

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        system, path = self._path(name)
        return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._names("current") if n.startswith("v")]

    def _load(self, name: str) -> tuple[int, int, list[Run]]:
        system, path = self._path(f"current/{name}")
        java, stream = self.spark._jvm.java.io, system.open(path)
        try:
            found = json.loads(java.BufferedReader(java.InputStreamReader(stream, "UTF-8")).readLine())
        finally:
            stream.close()
        return found["version"], found["seq"], [Run(**r) for r in found["runs"]]

    def _pointer(self) -> tuple[int, int, list[Run]] | None:
        names = self._pointers()
        return self._load(names[-1]) if names else None

    def _point(self, version: int, seq: int, runs: list[Run]) -> None:
        """Readers take these runs from now on. What neither this nor the pointer before names is removed."""
        before = self._pointers()
        n = int(before[-1].rpartition("-")[2]) + 1 if before else 0
        name = f"v{version:012d}-{n:012d}"
        system, draft = self._path(f"current/_{name}")
        out = system.create(draft, True)
        out.writeBytes(json.dumps({"version": version, "seq": seq, "runs": [asdict(r) for r in runs]}))
        out.close()
        system.rename(draft, self._path(f"current/{name}")[1])
        kept = {r.name for r in runs}
        if before:
            kept |= {r.name for r in self._load(before[-1])[2]}
        gone = [f"runs/{r}" for r in self._names("runs") if r not in kept] + [f"current/{p}" for p in before[:-1]]
        for old in gone:
            system.delete(self._path(old)[1], True)

    def current(self) -> tuple[int, int]:
        """(version, last seq); (-1, -1) before the first."""
        found = self._pointer()
        return found[:2] if found else (-1, -1)

    # Reading.

    def _runs(self) -> list[Run]:
        found = self._pointer()
        return found[2] if found else []

    def _table(self, runs: list[Run], kind: str, schema) -> DataFrame:
        folders = [f"{self.folder}/runs/{r.name}/{kind}" for r in runs]
        return self.spark.read.schema(schema).parquet(*folders) if runs else self.spark.createDataFrame([], schema)

    def _catalog_schema(self):
        return with_derived(self.spark.createDataFrame([], CATALOG)).schema.add("version", "long")

    def _latest(self, runs: list[Run], kind: str, schema, key: str) -> DataFrame:
        """Rows of the runs, with their versions, that no later one of them has replaced or removed."""
        rows = self._table(runs, kind, schema)
        gone = self._table(runs, "keys", KEYS).where(F.col("kind") == kind).groupBy(F.col("key").alias("g_key")).agg(F.max("version").alias("g_version"))
        # Keys are few beside the base. A row is the latest of its key unless a later version names it.
        later = (F.col(key).cast("string") == F.col("g_key")) & (F.col("g_version") > F.col("version"))
        return rows.join(_small(gone), later, "left_anti") if len(runs) > 1 else rows

    def catalog(self) -> DataFrame:
        """With derived columns."""
        return self._latest(self._runs(), "catalog", self._catalog_schema(), "id").drop("version")

    def paths(self) -> DataFrame:
        """path, body_key: which body a path has."""
        return self._latest(self._runs(), "paths", PATHS, "path").drop("version")

    def keyed_bodies(self) -> DataFrame:
        """body_key, body; also some that no path has any more."""
        return self._table(self._runs(), "bodies", KEYED_BODIES)

    def keyed_postings(self) -> DataFrame:
        """word, body_key; also of some bodies that no path has any more."""
        return self._table(self._runs(), "postings", KEYED_POSTINGS)

    def bodies(self) -> DataFrame:
        """path, body. The join moves bodies: a search takes keyed_bodies and joins what it finds in them."""
        return self.keyed_bodies().join(_small(self.paths()), "body_key").select("path", "body")

    def postings(self) -> DataFrame:
        return self.keyed_postings().join(_small(self.paths()), "body_key").select("word", "path")

    # Writing.

    def _save(self, df: DataFrame, run: str, kind: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/runs/{run}/{kind}")

    def _save_bodies(self, bodies: DataFrame, run: str, version: int) -> DataFrame:
        """Writes bodies(path, body) under new keys, and their postings; returns path, body_key, version."""
        to = f"{self.folder}/runs/{run}"
        key = F.concat_ws(".", F.lit(str(version)), F.monotonically_increasing_id())
        bodies.select("path", "body", key.alias("body_key")).write.mode("overwrite").parquet(f"{to}/bodies")
        saved = self.spark.read.schema("path string, body string, body_key string").parquet(f"{to}/bodies")
        words = build_postings(saved.select(F.col("body_key").alias("path"), "body")).withColumnRenamed("path", "body_key")
        write_postings(words, f"{to}/postings", "overwrite", "body_key")
        return saved.select("path", "body_key", F.lit(version).cast("long").alias("version"))

    def write(self, version: int, seq: int, catalog: DataFrame, bodies: DataFrame | None = None) -> None:
        """A whole catalog as the base, alone."""
        run, own = f"{version}-{version}", F.lit(version).cast("long").alias("version")
        self._save(with_derived(catalog.select(*CATALOG.names)).withColumn("version", own), run, "catalog")
        bodies = self.spark.createDataFrame([], BODIES) if bodies is None else bodies
        self._save(self._save_bodies(bodies, run, version), run, "paths")
        self._save(self.spark.createDataFrame([], KEYS), run, "keys")
        self._point(version, seq, [self._counted(version, version)])

    def _counted(self, lo: int, hi: int, tier: int = 0, base: bool = True) -> Run:
        kinds = {"catalog": self._catalog_schema(), "paths": PATHS} if base else {"keys": KEYS}
        return Run(lo, hi, sum(self._table([Run(lo, hi, 0)], k, s).count() for k, s in kinds.items()), tier)

    def write_part(
        self, version: int, seq: int, ids: DataFrame, rows: DataFrame, removed: DataFrame, moved: DataFrame, bodies: DataFrame
    ) -> None:
        """ids: of catalog rows that `rows` replace or remove; removed(path): paths whose bodies go; moved(path, body_key):
        bodies under new paths; bodies(path, body): new ones."""
        run, own = f"{version}-{version}", F.lit(version).cast("long").alias("version")
        self._save(with_derived(rows.select(*CATALOG.names)).withColumn("version", own), run, "catalog")
        paths = moved.select("path", "body_key", own).union(self._save_bodies(bodies, run, version))
        self._save(paths, run, "paths")
        named = self._table([Run(version, version, 0)], "paths", PATHS).select("path").union(removed.select("path")).distinct()
        keys = ids.select(F.lit("catalog").alias("kind"), F.col("id").cast("string").alias("key"), own)
        self._save(keys.union(named.select(F.lit("paths"), "path", own)), run, "keys")
        self._point(version, seq, [*self._runs(), self._counted(version, version, base=False)])
        self.compact()

    def compact(self) -> None:
        """Merges the runs that are due: `fanout` neighbours of one size, and all with the base when they have changed
        enough of it."""
        while True:
            version, seq, runs = self._pointer()
            base, others = runs[0], runs[1:]
            if others and REWRITE * sum(r.rows for r in others) >= base.rows and len(others) >= self.fanout:
                self._point(version, seq, [self._merged(runs, None)])
                continue
            last = others[-self.fanout :]
            if len(last) < self.fanout or len({r.tier for r in last}) > 1:
                return
            self._point(version, seq, [*runs[: -self.fanout], self._merged(last, last[0].tier + 1)])

    def _merged(self, runs: list[Run], tier: int | None) -> Run:
        """One run of these; tier null: they begin with the base, and nothing that is removed need be remembered."""
        lo, hi = runs[0].lo, runs[-1].hi
        name = Run(lo, hi, 0).name
        self._save(self._latest(runs, "catalog", self._catalog_schema(), "id"), name, "catalog")
        self._save(self._latest(runs, "paths", PATHS, "path"), name, "paths")
        bodies, words = self._table(runs, "bodies", KEYED_BODIES), self._table(runs, "postings", KEYED_POSTINGS)
        keys = self._table(runs, "keys", KEYS).groupBy("kind", "key").agg(F.max("version").alias("version"))
        if tier is None:
            keys = keys.where("false")
            live = _small(self._table([Run(lo, hi, 0)], "paths", PATHS).select("body_key").distinct())
            bodies, words = (df.join(live, "body_key", "left_semi") for df in (bodies, words))
        self._save(keys, name, "keys")
        self._save(bodies, name, "bodies")
        write_postings(words, f"{self.folder}/runs/{name}/postings", "overwrite", "body_key")
        return self._counted(lo, hi, tier or 0, base=tier is None)


def apply_batch(
    store: CatalogStore,
    batch: DataFrame,
    batch_id: int,
    extract: Callable[[DataFrame], DataFrame] | None = None,
    follow_renames: bool = False,
) -> None:
    """Fold one micro-batch. extract: (path, body) of created files (catalog columns), which are then searched as well,
    whatever their size or place. follow_renames: bodies go along with their files; else they stay under the path they
    were read from."""
    with scratch(store.spark):
        _apply(store, batch, batch_id, extract, follow_renames)


def _apply(store: CatalogStore, batch: DataFrame, batch_id: int, extract, follow_renames: bool) -> None:
    version, last = store.current()
    if batch_id + 1 <= version:
        return
    if version < 0:
        store.write(0, -1, store.catalog())
    batch = cut(batch.where(F.col("seq") > last))
    newest = batch.agg(F.max("seq")).first()[0]
    last = last if newest is None else newest
    ids = cut(batch.select("id").distinct())
    catalog = store.catalog().select(*CATALOG.names)
    # Only rows that changes name, or that lie below a renamed directory, take part.
    below = rows_below(catalog, cut(directory_renames(catalog, batch)))
    named = catalog.join(_small(ids), "id", "left_semi")
    before = cut(named.union(below.join(_small(ids), "id", "left_anti")))
    after = cut(apply_changes(before, batch))
    changed = before.select("id").union(ids).distinct()

    last_deed = batch.where("kind != 'rename'").groupBy("id").agg(F.max_by(F.struct("kind", "is_dir"), "seq").alias("deed"))
    made = cut(last_deed.where("deed.kind = 'create'").select("id", "deed.is_dir"))

    removed, moved = (store.spark.createDataFrame([], s) for s in ("path string", "path string, body_key string"))
    created = store.spark.createDataFrame([], BODIES)
    files = batch.where("kind = 'create' and not is_dir").select(*CATALOG.names)
    if follow_renames:
        # A file that is created anew is another one, and is read where it lies after the batch.
        files = after.join(_small(made.where("not is_dir")), "id", "left_semi")
        moves = before.select("id", "path").join(_small(made), "id", "left_anti")
        moves = moves.join(after.select("id", F.col("path").alias("new")), "id").where("path != new")
        found = cut(store.paths().join(_small(moves.select("path", "new")), "path").select("path", "new", "body_key"))
        removed, moved = found.select("path"), found.select(F.col("new").alias("path"), "body_key")
    if extract is not None:
        created = cut(extract(files).dropDuplicates(["path"]).select("path", "body"))
        moved = moved.join(created.select("path"), "path", "left_anti")
    store.write_part(batch_id + 1, last, changed, after, removed, moved, created)


def follow_changes(
    changes: DataFrame, store: CatalogStore, checkpoint: str, extract=None, follow_renames: bool = False, once: bool = False
) -> StreamingQuery:
    """Start following a stream of CHANGES rows. once: all that is there now, then stop."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: apply_batch(store, batch, batch_id, extract, follow_renames)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow_watcher(
    rows: DataFrame, store: CatalogStore, checkpoint: str, extract=None, follow_renames: bool = False, once: bool = False
) -> StreamingQuery:
    """Start following a stream of WATCHER rows: each batch meets the catalog that the ones before it have left, and its
    creations go on from the catalog's largest id."""
    from fileloom.sources.feeds import watcher_changes

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id + 1 > store.current()[0]:
            with scratch(store.spark):
                catalog = store.catalog().select(*CATALOG.names)
                first = catalog.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
                changes = watcher_changes(batch.where(F.col("seq") > store.current()[1]), catalog, first)
                apply_batch(store, changes, batch_id, extract, follow_renames)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()
