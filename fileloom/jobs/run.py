"""Whole jobs: index a tree, search an index. Roots and limits are arguments."""

from __future__ import annotations

import hashlib
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fileloom.functions.derive import with_derived
from fileloom.jobs.compile import compile_text
from fileloom.jobs.sinks import count_hits, write_json, write_paths
from fileloom.operators.postings import build_postings, write_postings
from fileloom.operators.rank import job_limits, with_rank
from fileloom.operators.search import search
from fileloom.sources.extract import EXTRACTABLE, extract_bodies, read_files, read_store
from fileloom.sources.feeds import journal_changes
from fileloom.sources.listing import body_gate, catalog_of_entries, list_store, list_tree
from fileloom.streaming.catalog_stream import CatalogStore, follow_changes, follow_watcher


#: Buckets of an index's catalog and bodies: one for some 256 MB of bodies.
BUCKETS = 32


def index_tree(
    spark: SparkSession, name_root: str, content_roots: list[str], out: str, mounted: bool = True, buckets: int = BUCKETS
) -> None:
    """catalog (with derived columns, so that filters reach the files), bodies and postings under `out`. Every entry below
    name_root is in the catalog; bodies are those of extractable files in the content roots. mounted: the tree is a folder
    that every executor has; else name_root is the URI of one in a store, and so are the content roots."""
    entries = list_tree(spark, name_root) if mounted else list_store(spark, name_root)
    _write_buckets(with_derived(catalog_of_entries(entries)), out, "catalog", buckets)
    gated = body_gate(spark.read.parquet(f"{out}/catalog"), content_roots, EXTRACTABLE)
    write_index(extract_bodies(read_files(spark, gated) if mounted else read_store(spark, gated, name_root)), out, buckets)


def write_index(bodies: DataFrame, out: str, buckets: int = BUCKETS) -> None:
    """bodies, in the buckets of their paths and sorted by these, so that they meet the catalog where they lie and those of
    few hits are found without reading all, and their postings."""
    spark = bodies.sparkSession
    _write_buckets(bodies, out, "bodies", buckets)
    write_postings(build_postings(spark.read.parquet(f"{out}/bodies")), f"{out}/postings")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{out}/layout")


def _table_name(out: str, kind: str) -> str:
    return f"fileloom_{hashlib.md5(out.rstrip('/').encode()).hexdigest()}_{kind}"


def _write_buckets(df: DataFrame, out: str, kind: str, buckets: int) -> None:
    """One file a bucket. The session's catalog of tables knows it from here on, or from index_table on."""
    name = _table_name(out, kind)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, "path").write.bucketBy(buckets, "path").sortBy("path")
    writer.option("path", f"{out}/{kind}").option("parquet.bloom.filter.enabled#path", "true").saveAsTable(name)


def index_table(spark: SparkSession, index: str, kind: str) -> DataFrame:
    """The catalog or the bodies of an index, with their buckets, so that the two are joined by path without a shuffle."""
    name = _table_name(index, kind)
    buckets = spark.read.schema("buckets int").json(f"{index}/layout").first()[0]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{index}/{kind}").schema)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{index}/{kind}'"
    )
    return spark.table(name)


def search_index(
    spark: SparkSession,
    index: str,
    text: str,
    now: datetime,
    files_only: bool = False,
    folders_only: bool = False,
    max_results: int = 0,
) -> DataFrame:
    """Hits of a free text in an index, in order; with a limit of the query's or the job's, their rank."""
    q = compile_text(text, now)
    catalog, bodies = (index_table(spark, index, kind) for kind in ("catalog", "bodies"))
    if q.limit is None:
        # Without a limit of the query's own, the job's kinds and limit are as good as the query's: snippets are cut last.
        if files_only and folders_only:
            raise ValueError("files only and folders only at once")
        catalog = catalog.where("not is_dir") if files_only else catalog.where("is_dir") if folders_only else catalog
        return search(catalog, bodies, replace(q, limit=max_results or None), now)
    hits = search(catalog, bodies, q, now)
    if files_only or folders_only or max_results:
        return job_limits(with_rank(hits, q), files_only, folders_only, max_results)
    return with_rank(hits, q)


def follow_feed(feed: DataFrame, store: CatalogStore, checkpoint: str, kind: str = "journal", **options) -> StreamingQuery:
    """A store's catalog, bodies and postings follow a stream of journal rows (schema.USN) or watcher rows
    (schema.WATCHER). options: extract, follow_renames and once of follow_changes."""
    if kind == "watcher":
        return follow_watcher(feed, store, checkpoint, **options)
    return follow_changes(journal_changes(feed), store, checkpoint, **options)


def search_store(store: CatalogStore, text: str, now: datetime) -> DataFrame:
    """Hits of a free text in what a store holds now, in order. Bodies are matched under their keys, where they lie: what
    is joined to paths, and these to the catalog, is flags."""
    q = compile_text(text, now)
    if not q.needs_body and not any(q.terms):
        return search(store.catalog(), None, q, now)
    return search(store.catalog().join(store.paths(), "path", "left"), store.keyed_bodies(), q, now, key="body_key")


def write_hits(hits: DataFrame, out: str, form: str = "paths", bounded: bool = False) -> None:
    """form: json, paths or count."""
    if form == "json":
        write_json(hits, out, bounded)
    elif form == "count":
        count_hits(hits).write.json(out)
    else:
        write_paths(hits, out)
