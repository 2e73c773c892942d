"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked when 3 bits or fewer differ. Exact, by tiles:

1. Documents with one fingerprint become one row (hash aggregation), so copies never meet each other.
2. Distinct fingerprints are range-partitioned and sorted by their population counts, of the whole, then of halves,
   quarters and eighths, and cut into tiles of TILE fingerprints (more where there would be over TILES tiles, so that the
   tiles' boxes, the least and largest counts, stay a table of a few MB that every task may have).
3. Each differing bit moves a population count by one. Two tiles whose boxes are further apart than the radius, in the
   sum over the parts of any of the four levels, can't hold a link and are skipped; blocks inside tiles likewise.
4. Tiles are dealt to cells, pairs of stripes of neighbouring tiles, and a cell compares its tiles by numpy's exclusive-or
   and bit counts. A cell holds two stripes at most, whatever is alike, and no tile goes to a cell in which it has no
   neighbour.
5. Of the links within a tile, and between a cell's tiles, only those are written that connect something new there: a
   spanning forest each, not all pairs of a group. Components are then contracted by DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .jaccard import components, few

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints in a tile and in a block of it, tiles in a stripe at most, and tiles that boxes are kept of at most.
TILE, BLOCK, STRIPE, TILES = 2048, 256, 16, 65_536
#: Widths of the parts whose population counts order and bound the fingerprints.
WIDTHS = (64, 32, 16, 8)
_STARTS = [at for w in WIDTHS for at in range(0, 64, w)]
_MASKS = np.array([((1 << w) - 1) << at for w in WIDTHS for at in range(0, 64, w)], np.uint64)
_LEVELS = np.repeat(np.arange(len(WIDTHS)), [64 // w for w in WIDTHS])


def fingerprint(text: str | None, seed: int = SEED, size: int = SHINGLE) -> int:
    """bytes.lower() is A-Z alone, bytes.split() ASCII white space alone. Repeated shingles count each time; a text of
    fewer words is one shingle; without words it is 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    k = min(size, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, print long")


def _order() -> list[Column]:
    """Population counts from the whole down, left parts alone: a right part's is what the left one leaves."""
    parts = [(w, at) for w, at in zip(np.repeat(WIDTHS, [64 // w for w in WIDTHS]).tolist(), _STARTS, strict=True)]
    return [F.bit_count(F.shiftrightunsigned("print", at).bitwiseAND((1 << w) - 1 if w < 64 else -1)) for w, at in parts if w == 64 or at // w % 2 == 0]


def counts(prints: np.ndarray) -> np.ndarray:
    """A row of population counts, by level and part, for each fingerprint."""
    return np.bitwise_count(prints[:, None] & _MASKS[None, :]).astype(np.int16)


def near(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the boxes (lows, highs) may hold a fingerprint within the radius of one in the box (low, high)."""
    gaps = np.maximum(0, np.maximum(lows - high, low - highs))
    return np.all(np.add.reduceat(gaps, np.flatnonzero(np.diff(_LEVELS, prepend=-1)), axis=1) <= radius, axis=1)


def _boxes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of the blocks of a tile."""
    found, starts = counts(prints), np.arange(0, len(prints), BLOCK)
    return np.minimum.reduceat(found, starts), np.maximum.reduceat(found, starts)


def links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a with links to b: the row and the rows of b, block by block; blocks that are too far are skipped."""
    low_a, high_a = _boxes(a)
    low_b, high_b = _boxes(b)
    for i, (low, high) in enumerate(zip(low_a, high_a, strict=True)):
        rows = a[i * BLOCK : (i + 1) * BLOCK, None]
        for j in np.flatnonzero(near(low, high, low_b, high_b, radius)):
            hit = np.bitwise_count(rows ^ b[None, j * BLOCK : (j + 1) * BLOCK]) <= radius
            for r in np.flatnonzero(hit.any(axis=1)):
                yield int(r) + i * BLOCK, np.flatnonzero(hit[r]) + int(j) * BLOCK


class _Forest:
    """Who is connected to whom, by union-find over a few thousand nodes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _within(prints: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The first member of each fingerprint's component in its own tile, and the links of a spanning forest."""
    forest, found = _Forest(len(prints)), []
    for i, others in links(prints, prints):
        found += [(i, j) for j in others[others > i].tolist() if forest.join(i, j)]
    return np.array([forest.top(i) for i in range(len(prints))], np.int32), found


TILE_TYPE = "tile long, prints binary, tops binary, low array<short>, high array<short>, a array<long>, b array<long>"


def _tiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(prints: np.ndarray) -> pa.RecordBatch:
            nonlocal n
            found = counts(prints)
            tops, forest = _within(prints)
            ends = [[int(prints[p[k]].astype(np.int64)) for p in forest] for k in (0, 1)]
            row = {
                "tile": [part << 32 | n], "prints": [prints.tobytes()], "tops": [tops.tobytes()],
                "low": [found.min(axis=0).tolist()], "high": [found.max(axis=0).tolist()], "a": [ends[0]], "b": [ends[1]],
            }
            n += 1
            return pa.RecordBatch.from_pydict(row, schema=schema)

        lists = pa.list_(pa.int16()), pa.list_(pa.int64())
        schema = pa.schema(
            [("tile", pa.int64()), ("prints", pa.binary()), ("tops", pa.binary()), ("low", lists[0]), ("high", lists[0]), ("a", lists[1]), ("b", lists[1])]
        )
        part, n, held = 0, 0, np.empty(0, np.uint64)
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            held = np.concatenate([held, batch.column("print").to_numpy().view(np.uint64)])
            while len(held) >= size:
                yield made(held[:size])
                held = held[size:]
        if len(held):
            yield made(held)

    return run


CELL_TYPE = "cell long, tile int, prints binary, tops binary"


def _deal(shared, stripe: int):
    """A tile's row for each cell in which it has a neighbour other than itself. Tiles are known by their place in the
    order; a cell is the pair of the places' stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lows, highs = shared.value
        schema = pa.schema([("cell", pa.int64()), ("tile", pa.int32()), ("prints", pa.binary()), ("tops", pa.binary())])
        for batch in batches:
            for row in range(batch.num_rows):
                at = int(np.searchsorted(names, batch.column("tile")[row].as_py()))
                others = np.flatnonzero(near(lows[at], highs[at], lows, highs))
                others = np.unique(others[others != at] // stripe)
                own = at // stripe
                cells = np.minimum(others, own).astype(np.int64) << 32 | np.maximum(others, own)
                prints, tops = batch.column("prints")[row].as_py(), batch.column("tops")[row].as_py()
                for cell in cells.tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell]), pa.array([at], pa.int32()), pa.array([prints], pa.binary()), pa.array([tops], pa.binary())], schema=schema
                    )

    return run


def _compare(stripe: int):
    """Links between the tiles of a cell that connect components of theirs for the first time."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["tile"])
        first, second = divmod(rows[0]["cell"], 1 << 32) if rows else (0, 0)
        prints = [np.frombuffer(r["prints"], np.uint64) for r in rows]
        base = np.cumsum([0, *map(len, prints)])
        tops = [np.frombuffer(r["tops"], np.int32) + base[k] for k, r in enumerate(rows)]
        forest, flat, found = _Forest(int(base[-1])), np.concatenate(prints), []
        for x, left in enumerate(rows):
            for y in range(x + 1, len(rows)):
                if (left["tile"] // stripe, rows[y]["tile"] // stripe) != (first, second):
                    continue
                for i, others in links(prints[x], prints[y]):
                    i += int(base[x])
                    own = int(tops[x][i - base[x]])
                    tops_y, at = np.unique(tops[y][others], return_index=True)
                    for top, j in zip(tops_y.tolist(), (others[at] + base[y]).tolist(), strict=True):
                        if forest.join(own, top):
                            found.append((i, j))
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({c: pa.array(flat[ends[:, k]].view(np.int64)) for k, c in enumerate("ab")})

    return run


def _links(distinct: DataFrame, tables: Tables) -> DataFrame:
    """a, b: links whose components are those of all links between the fingerprints distinct(print)."""
    spark = distinct.sparkSession
    size = max(TILE, -(-distinct.count() // TILES))
    order = [c.alias(f"c{k}") for k, c in enumerate(_order())]
    keys = [f"c{k}" for k in range(len(order))] + ["print"]
    rows = distinct.select("print", *order).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select("print", F.spark_partition_id().alias("part"))
    tiles = tables.save(rows.mapInArrow(_tiles(size), TILE_TYPE), "tiles")
    within = tiles.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b")

    # The boxes alone: at most some TILES rows (and one a partition) of 30 small numbers.
    boxes = tiles.select("tile", "low", "high").toArrow().sort_by("tile")
    if boxes.num_rows < 2:
        return within
    names = boxes["tile"].to_numpy()
    low, high = (np.array(boxes[c].to_pylist(), np.int16) for c in ("low", "high"))
    stripe = max(1, min(STRIPE, len(names) // 64))
    shared = spark.sparkContext.broadcast((names, low, high))
    dealt = tiles.select("tile", "prints", "tops").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    cells = dealt.mapInArrow(_deal(shared, stripe), CELL_TYPE)
    across = cells.groupBy("cell").applyInArrow(_compare(stripe), "a long, b long")
    return within.union(tables.save(across, "across"))


def link_prints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs(doc_id, text).

    component_id: the smallest doc_id that links reach, its own included; nulls do not count (a group of null ids alone
    has null). Null, empty and wordless texts have the fingerprint 0, which is linked like any other. Repeated rows give
    repeated rows; other columns are not read. Empty table: empty result."""
    tables = Tables(docs.sparkSession, "simhash")
    prints = tables.save(fingerprints(docs), "prints")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
    distinct = tables.save(distinct, "distinct")
    found = tables.save(_links(distinct.select("print"), tables), "links")
    groups = distinct.withColumn("comp", F.col("print"))
    if not found.isEmpty():
        comps = components(found, tables, "stars")
        groups = distinct.join(few(comps), F.col("print") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "print"))
    groups = tables.save(groups.select("print", "least", "many", "comp"), "groups")
    least = groups.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("many").alias("n")).where("n > 1")
    least = tables.save(least.select(F.col("comp").alias("l_comp"), "component_id"), "least")
    # Of the fingerprints of components of several rows alone; written down, so that Spark can split a hot one's join.
    of_print = groups.join(few(least), F.col("comp") == F.col("l_comp")).select(F.col("print").alias("l_print"), "component_id")
    of_print = tables.save(of_print, "of-print")
    rows = prints.join(few(of_print), F.col("print") == F.col("l_print"), "left")
    tables.remove("tiles", "across", "distinct", "groups", "least", "links")
    text = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return rows.select("doc_id", text, F.coalesce("component_id", "doc_id").alias("component_id"))
