"""The content index: words of bodies, lookups in them, upkeep of bodies."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.functions.text import words


def build_postings(bodies: DataFrame) -> DataFrame:
    """word, path: the distinct words of each body. Words are made distinct inside the row first, and a path has one
    body, so nothing is shuffled, whatever words are frequent."""
    return bodies.select(F.explode(F.array_distinct(words(F.col("body")))).alias("word"), "path")


#: Bytes of a row group of postings: a lookup reads those of its words, and a filter of each says which words it has not.
GROUP_BYTES = 8 << 20


def write_postings(postings: DataFrame, folder: str, mode: str = "error", of: str = "path") -> None:
    """In the order of words, so that a lookup reads the files and row groups of its words alone, and none for most words
    that are not there (a Bloom filter for each row group); a frequent word takes several files."""
    writer = postings.repartitionByRange("word", of).sortWithinPartitions("word", of).write.mode(mode)
    writer = writer.option("parquet.bloom.filter.enabled#word", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.option("parquet.block.size", GROUP_BYTES).parquet(folder)


def paths_for_word(postings: DataFrame, word: str) -> DataFrame:
    return postings.where(F.col("word") == word.lower()).select("path")


def paths_for_all_words(postings: DataFrame, wanted: list[str]) -> DataFrame:
    """Paths that have every word."""
    low = sorted({w.lower() for w in wanted})
    found = postings.where(F.col("word").isin(low)).groupBy("path").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(low)).select("path")


def files_with_word(catalog: DataFrame, postings: DataFrame, word: str) -> DataFrame:
    return catalog.join(paths_for_word(postings, word), "path", "left_semi")


def contains_all(bodies: DataFrame, terms: list[str]) -> DataFrame:
    """Bodies that have each term anywhere, whatever its case."""
    low = F.lower("body")
    return bodies.where(reduce(and_, (low.contains(t.lower()) for t in terms), F.lit(True)))


def upsert_bodies(bodies: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(seq, path, body): the last of a path wins, a null body removes the path. Only the latest change of a path
    is looked for (partial maxima), and bodies without a change are not shuffled with their texts' histories."""
    latest = changes.groupBy("path").agg(F.max_by("body", "seq").alias("body"))
    kept = bodies.join(latest.select("path"), "path", "left_anti")
    return kept.select("path", "body").unionByName(latest.where(F.col("body").isNotNull()).select("path", "body"))


def upsert_postings(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """Postings of changed paths are dropped and made again from the latest bodies."""
    latest = changes.groupBy("path").agg(F.max_by("body", "seq").alias("body"))
    kept = postings.join(latest.select("path"), "path", "left_anti")
    return kept.select("word", "path").union(build_postings(latest.where(F.col("body").isNotNull())))


def next_id(catalog: DataFrame) -> DataFrame:
    return catalog.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))
