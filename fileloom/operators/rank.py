"""Score, order and limits of hits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileloom.functions.derive import ascii_lower
from fileloom.operators.query import Query

#: Weights, and the seconds in which a change still counts as recent.
NAME, PATH, BODY, EXACT_STEM, RECENT = 1000.0, 100.0, 10.0, 200.0, 50.0
RECENT_SECONDS = 604_800


def score(q: Query, now: datetime) -> Column:
    """Of a row with stem, modified, name_match, path_match and content_match. A change after `now` is not recent."""
    found = F.when(F.col("name_match"), NAME).when(F.col("path_match"), PATH).otherwise(0.0)
    found = found + F.when(F.col("content_match"), BODY).otherwise(0.0)
    if terms := sorted({"".join(c.lower() if c.isascii() else c for c in t) for t in q.terms}):
        found = found + F.when(ascii_lower(F.col("stem")).isin(terms), EXACT_STEM).otherwise(0.0)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("modified")) / 1e6
    recent = F.when((age >= 0) & (age < RECENT_SECONDS), RECENT * (1.0 - age / RECENT_SECONDS)).otherwise(0.0)
    return found + recent


def order(q: Query) -> list[Column]:
    """Ties end with the id, so that every order is total."""
    first = {"score": [F.desc("score")], "size": [F.desc("size")], "date": [F.desc("modified")], "name": []}[q.sort]
    return [*first, F.asc("name"), F.asc("id")]


def ordered(hits: DataFrame, q: Query) -> DataFrame:
    """In order; with a limit its first rows (k rows a task are kept, nothing is sorted whole), with their rank."""
    if q.limit is None:
        return hits.orderBy(*order(q))
    return hits.orderBy(*order(q)).limit(q.limit)


def with_rank(hits: DataFrame, q: Query) -> DataFrame:
    """rank from 1, for hits that a limit bounds."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order(q))))


def job_limits(
    ranked: DataFrame, files_only: bool = False, folders_only: bool = False, max_results: int = 0
) -> DataFrame:
    """What a job asks for beyond the query, applied after the query's own limit; 0 results: all."""
    if files_only and folders_only:
        raise ValueError("files only and folders only at once")
    if files_only or folders_only:
        ranked = ranked.where(~F.col("is_dir") if files_only else F.col("is_dir"))
    return ranked.orderBy("rank").limit(max_results) if max_results else ranked
