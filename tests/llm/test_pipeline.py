import os

import corpus_pipeline
import __spark_entry__


def test_stages_keep_columns_and_only_remove_rows(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert set(after) <= set(before) and all(before[i] == t for i, t in after.items()) and after
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            before = after
    mixed = docs.collect()
    assert {r.doc_id for r in mixed} == set(before)
    for source_size, target in {(r.source_size, r.target) for r in mixed}:
        assert 0 <= target <= 2 * source_size


def test_queries_and_sql_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
