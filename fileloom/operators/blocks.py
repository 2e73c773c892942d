"""The array form of the word index: for each word, blocks of the sorted numbers of the paths that have it.

Paths are numbered in their order. A block holds a word's numbers from one span of them, as differences, with the first and
the last: so a word that every body has is split over many rows, however many bodies there are, and no row holds more
than SPAN numbers. Bodies with the numbers of one chunk of a span are brought together, and their words are put in order in
one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.functions.text import words
from fileloom.sources.listing import numbered
from fileloom.sources.tables import cut, scratch

#: Numbers of paths that a block may hold.
SPAN = 1 << 16
#: Numbers whose bodies' words are put in order at once, in one task.
CHUNK = 1 << 12


def _blocks(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows(chunk, n, words) that come in the order of n, with whole chunks."""

    def of_chunk(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        ns, lists = table["n"].to_numpy(), table["words"]
        codes = lists.combine_chunks().flatten().dictionary_encode()
        ns = np.repeat(ns, lists.combine_chunks().value_lengths().fill_null(0).to_numpy())
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        code, ns = codes.indices.to_numpy()[order], ns[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        ends = np.append(starts[1:], len(ns))[: len(starts)]
        deltas = np.diff(ns, prepend=0)
        deltas[starts] = 0
        found = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ns)), pa.int32()), pa.array(deltas, pa.int32()))
        columns = [codes.dictionary.take(pa.array(code[starts])), ns[starts] // span, ns[starts], ns[ends - 1], ends - starts]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), found], names=["word", "block", "first", "last", "many", "deltas"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low < high and chunks[low] != at:
                    if held:
                        yield of_chunk(held)
                    held, at = [], chunks[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield of_chunk(held)

    return run


def build_blocks(bodies: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """numbers(path, n), n from 0 on, and blocks(word, block, first, last, many, deltas) of bodies(path, body).

    What is shuffled is bodies, by their chunk of numbers, not a row for each word of each body. Only where a span is
    larger than a chunk are a word's lists of its chunks put together by a second shuffle."""
    rows = numbered(bodies.select("path", "body"), "path", 0).withColumnRenamed("id", "n")
    of_span = -(-span // CHUNK)
    chunk = F.floor(F.col("n") / span) * of_span + F.floor(F.col("n") % span / CHUNK)
    placed = rows.select(chunk.alias("chunk"), "n", "body").repartition("chunk").sortWithinPartitions("n")
    placed = placed.select("chunk", "n", F.array_distinct(words(F.col("body"))).alias("words"))
    found = placed.mapInArrow(_blocks(span), "word string, block long, first long, last long, many long, deltas array<int>")
    if of_span > 1:
        parts = F.sort_array(F.collect_list(F.struct("first", "last", "many", "deltas")))
        found = found.groupBy("word", "block").agg(parts.alias("parts"))
        before = lambda i: F.element_at("parts", F.greatest(i, F.lit(1))).last
        joined = lambda p, i: F.when(i == 0, p.deltas).otherwise(
            F.concat(F.array((p.first - before(i)).cast("int")), F.slice(p.deltas, F.lit(2), F.size(p.deltas)))
        )
        many = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p.many)
        found = found.select(
            "word", "block", F.element_at("parts", 1)["first"].alias("first"), F.element_at("parts", -1)["last"].alias("last"),
            many.alias("many"), F.flatten(F.transform("parts", joined)).alias("deltas"),
        )
    return rows.select("path", "n"), found


def write_blocks(bodies: DataFrame, folder: str, span: int = SPAN) -> None:
    """numbers and blocks under the folder, blocks in the order of words. They are written down before they are ordered:
    the ranges of words are found by a pass over them, which would make them once more."""
    with scratch(bodies.sparkSession):
        numbers, blocks = build_blocks(bodies, span)
        numbers.write.parquet(f"{folder}/numbers")
        ordered = cut(blocks).repartitionByRange("word", "block").sortWithinPartitions("word", "block").write
        ordered.option("parquet.bloom.filter.enabled#word", "true").parquet(f"{folder}/blocks")


def read_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/numbers"), spark.read.parquet(f"{folder}/blocks")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers that all parts of a block have."""
    for batch in batches:
        for parts in batch.column("parts"):
            left = None
            # The shortest list first: no list is longer than what is left of it.
            for part in sorted(parts, key=lambda p: p["many"].as_py()):
                numbers = part["first"].as_py() + np.cumsum(part["deltas"].values.to_numpy().astype(np.int64))
                left = numbers if left is None else left[np.isin(left, numbers, assume_unique=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64())], names=["n"])


def numbers_with_all_words(blocks: DataFrame, wanted: list[str]) -> DataFrame:
    """n of the paths that have every word. Spans that lack a word, or in which the words' ranges don't meet, are skipped by
    the blocks' heads alone; only the other blocks' numbers are read and compared, span by span."""
    low = sorted({w.lower() for w in wanted})
    own = blocks.where(F.col("word").isin(low))
    heads = own.groupBy("block").agg(F.count("*").alias("words"), F.max("first").alias("from"), F.min("last").alias("to"))
    heads = heads.where((F.col("words") == len(low)) & (F.col("from") <= F.col("to"))).select("block")
    parts = own.join(heads, "block", "left_semi").groupBy("block")
    # As many rows as words, of at most SPAN numbers each.
    parts = parts.agg(F.collect_list(F.struct("first", "many", "deltas")).alias("parts"))
    return parts.select("parts").mapInArrow(_common, "n long")


def paths_with_all_words(numbers: DataFrame, blocks: DataFrame, wanted: list[str]) -> DataFrame:
    return numbers.join(numbers_with_all_words(blocks, wanted), "n", "left_semi").select("path")
