"""Changes folded into a catalog: per id the last creation or deletion and the last rename after it; renames of
directories move everything below them, in the order in which they happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileloom.operators.folders import FolderNames, moved_path
from fileloom.schema import CATALOG
from fileloom.sources.tables import cut

#: Directory renames that each path may be held against one by one; those whose versions of folder names each task may
#: have (within BROADCAST_BYTES of paths); more are joined on each path's folders.
LITERAL_RENAMES, MOST_RENAMES = 100, 100_000
#: Old and new paths of joined renames that are broadcast, in bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


def _last_by_id(changes: DataFrame) -> DataFrame:
    """One row per id, by partial maxima, so that a hot id is reduced before the shuffle."""
    seq = F.when(F.col("kind").isin("create", "delete"), F.col("seq"))
    moved = F.when(F.col("kind") == "rename", F.col("seq"))
    row = F.struct("kind", *[c for c in CATALOG.names if c != "id"])
    return changes.groupBy("id").agg(
        F.max(seq).alias("base_seq"),
        F.max_by(row, seq).alias("base"),
        F.max(moved).alias("move_seq"),
        F.max_by(F.struct("name", "path"), moved).alias("move"),
    )


def fold_changes(catalog: DataFrame, changes: DataFrame, keep_seq: bool = False) -> DataFrame:
    """The catalog after changes(seq, kind, catalog columns), arrival by seq. A creation sets the whole row, a deletion
    drops it (what is below a deleted directory stays), a rename sets name and path of a row that is there and nothing
    else. keep_seq: adds path_seq, when the row got its path (0: before all changes)."""
    last = _last_by_id(changes).withColumnRenamed("id", "c_id")
    both = catalog.select(*CATALOG.names).join(last, F.col("id") == F.col("c_id"), "full_outer")
    both = both.where("coalesce(base.kind = 'create', id is not null and base is null)")
    created = F.col("base").isNotNull()
    moved = F.coalesce(F.col("move_seq") > F.coalesce("base_seq", F.lit(-1)), F.lit(False))
    columns: dict[str, Column] = {"id": F.coalesce("id", "c_id")}
    for c in CATALOG.names[1:]:
        columns[c] = F.when(created, F.col(f"base.{c}")).otherwise(F.col(c))
    for c in ("name", "path"):
        columns[c] = F.when(moved, F.col(f"move.{c}")).otherwise(columns[c])
    out = [columns[c].alias(c) for c in CATALOG.names]
    if keep_seq:
        seq = F.when(moved, F.col("move_seq")).otherwise(F.coalesce("base_seq", F.lit(0)))
        out.append(seq.cast("long").alias("path_seq"))
    return both.select(*out)


def _moved(path: Column, old: Column, new: Column) -> Column:
    """The path if it lay below old, else null."""
    below = F.startswith(path, F.concat(old, F.lit("\\"))) | F.startswith(path, F.concat(old, F.lit("/")))
    return F.when(below, F.concat(new, F.substring(path, F.length(old) + 1, F.length(path))))


def directory_renames(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """seq, old, new for each rename of a directory, old as it was just before.

    Only directories that are renamed are followed. What a directory's own last event says of its path is known from a
    window over its id; renames of what it lies in, between that event and its own rename, move it like any other path.
    Their old paths are found in the same way, so all are moved again until nothing changes: the first rename's is right
    at once, and each other one's as soon as those that it depends on are, one round for each level of renamed
    directories."""
    renamed = changes.where("kind = 'rename'").select("id").distinct()
    old = catalog.where("is_dir").join(renamed, "id", "left_semi")
    new = changes.where("kind = 'create' and is_dir").join(renamed, "id", "left_semi").select("id")
    dirs = old.select("id").union(new).distinct()
    rows = old.select(F.lit(0).cast("long").alias("seq"), F.lit("create").alias("kind"), "id", "path")
    log = changes.join(dirs, "id", "left_semi")
    # A file that is created under a directory's former id is no directory: it ends what the id stood for.
    kind = F.when((F.col("kind") == "create") & ~F.col("is_dir"), "delete").otherwise(F.col("kind"))
    rows = rows.union(log.select("seq", kind.alias("kind"), "id", "path"))
    own = Window.partitionBy("id").orderBy("seq")
    there = F.last(F.when(F.col("kind") != "rename", F.col("kind")), ignorenulls=True).over(own)
    rows = rows.withColumns({"there": there, "since": F.lag("seq").over(own), "said": F.lag("path").over(own)})
    rows = rows.where("kind = 'rename' and there = 'create'").select("seq", "since", "said", F.col("path").alias("new"))
    rows = cut(rows.withColumn("old", F.col("said")))
    if len(rows.limit(2).collect()) < 2:
        return rows.where("old != new").select("seq", "old", "new")
    while True:
        again = rows.select("seq", "since", "said", "new", F.col("said").alias("old"), F.col("old").alias("before"))
        rows = cut(move_below(again, rows.select("seq", "old", "new"), "old", "since", until="seq"))
        if rows.where("old != before").isEmpty():
            return rows.where("old != new").select("seq", "old", "new")


def folders(path: Column) -> Column:
    """The folders that a path lies in, from the outermost; null for none."""
    parts = F.split(path, r"(?=[\\/])")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), ""))
    return F.when(F.size(parts) > 1, folders)


def rows_below(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows(id, path) that lie below a directory that is renamed."""
    n, size = renames.agg(F.count("*"), F.sum(F.octet_length("old"))).first()
    if n <= LITERAL_RENAMES:
        found = F.lit(False)
        for r in renames.select("old").distinct().collect():
            found = found | _moved(F.col("path"), F.lit(r.old), F.lit("")).isNotNull()
        return rows.where(found)
    old = renames.select("old").distinct()
    old = F.broadcast(old) if size <= BROADCAST_BYTES else old
    below = rows.select("id", F.explode(folders(F.col("path"))).alias("old")).join(old, "old", "left_semi")
    return rows.join(below.select("id").distinct(), "id", "left_semi")


def _next_moves(paths: DataFrame, renames: DataFrame) -> DataFrame:
    """Of paths(path, since, until, at, now) those that a rename later than now and earlier than until moves from at,
    by the first such rename of any of their folders."""
    seen = paths.select("*", F.explode(folders(F.col("at"))).alias("old")).join(renames, "old")
    seen = seen.where("seq > now and seq < until").groupBy("path", "since", "until", "at")
    first = seen.agg(F.min(F.struct("seq", "old", "new")).alias("step"))
    moved = _moved(F.col("at"), F.col("step.old"), F.col("step.new"))
    return first.select("path", "since", "until", moved.alias("at"), F.col("step.seq").alias("now"))


def move_below(rows: DataFrame, renames: DataFrame, path: str = "path", seq: str = "path_seq", until: str | None = None) -> DataFrame:
    """rows with each path moved by all renames(seq, old, new) that are later than its own seq (and earlier than its
    until), in order.

    A few renames are a literal, and up to MOST_RENAMES (or BROADCAST_BYTES of them) versions of folder names that are
    broadcast: one pass over the rows, however often a path is moved. Beyond, paths meet the renames of their folders by
    an equi-join; only paths that one has moved are written and meet them again, and what becomes of these is joined to
    the rows."""
    renames = renames.where("old != new").select("seq", "old", "new")
    found = sorted(tuple(r) for r in renames.limit(LITERAL_RENAMES + 1).collect())
    if not found:
        return rows
    end = F.lit(2**63 - 1) if until is None else F.col(until)
    if len(found) <= LITERAL_RENAMES:
        steps = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(o).alias("o"), F.lit(w).alias("w")) for s, o, w in found])
        steps = F.filter(steps, lambda r: (r.s > F.col(seq)) & (r.s < end))
        return rows.withColumn(
            path, F.aggregate(steps, F.col(path), lambda p, r: F.coalesce(_moved(p, r.o, r.w), p))
        )
    renames = cut(renames)
    many, size = renames.agg(F.count("*"), F.sum(F.octet_length("old") + F.octet_length("new"))).first()
    if many <= MOST_RENAMES and size <= BROADCAST_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast(FolderNames(tuple(r) for r in renames.collect()))
        return rows.withColumn(path, moved_path(shared, F.col(path), F.col(seq), end))
    if size <= BROADCAST_BYTES:
        renames = F.broadcast(renames)
    paths = rows.select(F.col(path).alias("path"), F.col(seq).alias("since"), end.alias("until"))
    step = cut(_next_moves(paths.select("*", F.col("path").alias("at"), F.col("since").alias("now")), renames))
    moves = step
    while not step.isEmpty():
        step = cut(_next_moves(step, renames))
        moves = moves.union(step)
    last = moves.groupBy("path", "since", "until").agg(F.max_by("at", "now").alias("_at"))
    last = last.select(F.col("path").alias("_path"), F.col("since").alias("_since"), F.col("until").alias("_until"), "_at")
    met = (F.col(path) == F.col("_path")) & (F.col(seq) == F.col("_since")) & (end == F.col("_until"))
    return rows.join(last, met, "left").withColumn(path, F.coalesce("_at", path)).drop("_path", "_since", "_until", "_at")


def apply_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog after all changes, with what lies below renamed directories moved along."""
    folded = fold_changes(catalog, changes, keep_seq=True)
    return move_below(folded, directory_renames(catalog, changes)).drop("path_seq")


def move_bodies(bodies: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Bodies under the new paths of files that changes have moved. Without this, as in apply_changes alone, a body stays
    under the path that it was read from."""
    moves = before.select("id", F.col("path").alias("old")).join(after.select("id", F.col("path").alias("new")), "id")
    moves = moves.where("old != new").select("old", "new")
    return bodies.join(moves, F.col("path") == F.col("old"), "left").select(F.coalesce("new", "path").alias("path"), "body")
