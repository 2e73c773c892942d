"""Filter interaction audit: what each filter removes, after every set of other filters, in all orders.

A trie of permutations, executed depth first: a node is a set of filters that have been applied, whatever their order, and
holds the documents that survive them all as a persisted DataFrame, made from its parent's by the one filter between them.
The first order that reaches a set computes it; all others find its counts (32 sets for five filters, not 326 prefixes).
At each node one aggregation counts, part by part, what every filter not yet applied removes there: the counts of all
edges that leave it. A node's survivors are released when its subtree is done, so at most as many are held as there are
filters.

The texts are read once: each document becomes a slim row (its part, which filters it fails, its labels), written to the
shared folder, from which a lost executor's survivors are computed again. The report joins nothing wide: a part has 32
rows of counts, and each of its rows looks its counts up there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .jaccard import few

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


def fails(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Filters A to D on a text in UTF-8. bytes.split() is ASCII white space alone."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    return (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * upper > MAX_UPPER_PERCENT * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*FILTERS[:4], "digest"]
    for batch in batches:
        found = []
        for text in batch.column("text"):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            found.append((*fails(data), hashlib.sha256(data).digest()))
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        kinds = [*[pa.bool_()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "part", *names],
        )


def measure_filters(docs: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """part, A to E (whether the document fails the filter), good, toxic for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), part)
    flags = ", ".join(f"{f} boolean" for f in FILTERS[:4])
    rows = tables.save(rows.mapInArrow(_measure, f"doc_id {kind}, part string, {flags}, digest binary"), "measured")
    # The first of each text that several rows have; few texts, written down so that Spark can split a hot one's join.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).where("many > 1")
    first = few(tables.save(first.select(F.col("digest").alias("f_digest"), "first"), "first"))
    rows = rows.join(first, F.col("digest") == F.col("f_digest"), "left")
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")
    marks = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("l_id"))
    marks = marks.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    rows = rows.select("doc_id", "part", *FILTERS[:4], copied).join(few(tables.save(marks, "marks")), F.col("doc_id") == F.col("l_id"), "left")
    marked = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return tables.save(rows.select("part", *FILTERS, *marked), "documents")


def _total(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


class Trie:
    """Counts of all edges, as tables of one row a part and node: node (its filters as bits), kept (its survivors), and for
    each filter f that is not in it removed_f, good_f, toxic_f (null for those that are)."""

    def __init__(self, documents: DataFrame, tables: Tables):
        self.tables, self.counted = tables, {}
        self._walk(documents, 0)

    def _walk(self, survivors: DataFrame, node: int) -> None:
        """Depth first: counts the node's edges and goes down those whose set no other order has reached before."""
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.count("*").alias("kept")]
        for k, f in enumerate(FILTERS):
            for name, of in (("removed", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
                count = F.lit(None).cast("long") if node >> k & 1 else _total(F.col(f) & of)
                counts.append(count.alias(f"{name}_{f}"))
        self.counted[node] = self.tables.save(survivors.groupBy("part").agg(F.lit(node).alias("node"), *counts), f"node-{node}")
        for k, f in enumerate(FILTERS):
            below = node | 1 << k
            if below != node and below not in self.counted:
                self._walk(survivors.where(~F.col(f)), below)
        survivors.unpersist()

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.counted.values())


def _orders() -> list[tuple[str, int, int, int]]:
    """order, step, the filters before it as bits, its own filter: 600 rows for five filters."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            found.append(("".join(FILTERS[i] for i in order), step, before, k))
            before |= 1 << k
    return found


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (each lang of docs(doc_id, lang, text), null: ''), filter_order and step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null and empty texts are one text, with no words: they fail A, and E where a smaller doc_id has one as well. A null
    doc_id is not smaller than any and has no smaller one, and no labels; rows that repeat id and text don't fail E by one
    another. Of several labels of a doc_id any may mark it. A part of which nothing is left has zeros. Other columns are not
    read. Empty table: empty result."""
    tables, n = Tables(docs.sparkSession, "audit"), len(FILTERS)
    documents = measure_filters(docs, labels, tables)
    tables.remove("measured", "first", "marks")
    edges = [F.array(*[f"{name}_{f}" for f in FILTERS]).alias(name) for name in ("removed", "good", "toxic")]
    # A part's rows: 32 at most, one for each set of filters.
    nodes = Trie(documents, tables).rows().select("part", "node", F.struct("kept", *edges).alias("counts"))
    parts = tables.save(nodes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("node", "counts"))).alias("nodes")), "parts")
    tables.remove("documents", *(f"node-{k}" for k in range(1 << n)))

    value = lambda node, name, k: F.coalesce(F.element_at("nodes", node)[name][k], F.lit(0))
    shapley = []
    for k in range(n):
        without = [s for s in range(1 << n) if not s >> k & 1]
        orders = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
        shapley.append(reduce(add, (value(F.lit(s), "removed", F.lit(k)) * F.lit(orders(s)) for s in without)))
    named = lambda **fields: F.struct(*[F.lit(v).alias(c) for c, v in fields.items()])
    others = lambda k: (1 << n) - 1 - (1 << k)
    steps = F.array(*[named(filter_order=o, step=s, before=b, k=k, others=others(k)) for o, s, b, k in _orders()])
    rows = parts.select("part", "nodes", F.array(*shapley).alias("shapley"), F.explode(steps).alias("s"))
    before, k = F.col("s.before"), F.col("s.k")
    removed = value(before, "removed", k)
    kept = F.coalesce(F.element_at("nodes", before)["kept"], F.lit(0)) - removed
    return rows.select(
        "part", "s.filter_order", "s.step", kept.alias("kept"), removed.alias("removed"),
        (value(F.lit(0), "removed", k) - removed).alias("redundant"), value(F.col("s.others"), "removed", k).alias("unique_fails"),
        value(before, "good", k).alias("good_lost"), value(before, "toxic", k).alias("toxic_lost"), F.col("shapley")[k].alias("shapley"),
    )
