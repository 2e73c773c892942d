"""Results of a search as JSON lines, as paths, or as a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(hits: DataFrame) -> DataFrame:
    """One object per hit; highlights as pairs, empty without a snippet; a missing snippet is left out."""
    pairs = F.transform(F.coalesce(F.col("snippet.highlights"), F.expr("cast(array() as array<struct<start:int,end:int>>)")),
                        lambda h: F.array(h.start, h.end))
    row = F.struct("path", "name", "score", "name_match", "path_match", "content_match",
                   F.col("snippet.text").alias("snippet"), pairs.alias("highlights"))
    return hits.select(F.to_json(row).alias("value"))


def write_json(hits: DataFrame, folder: str, bounded: bool) -> None:
    """In rank order. bounded: a limit bounds the hits, so that one file can hold them in order."""
    rows = json_rows(hits)
    (rows.coalesce(1) if bounded else rows).write.text(folder)


def write_paths(hits: DataFrame, folder: str) -> None:
    hits.select("path").write.text(folder)


def count_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("hits"))
