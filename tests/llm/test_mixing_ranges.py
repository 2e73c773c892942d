"""Ranges of keys are even whatever the weights of a source are."""

import pytest
from pyspark.sql import functions as F

from fileloom.llm import mixing


@pytest.mark.parametrize("most", [10_000, 0])
def test_ranges_are_even_and_ordered(spark, most, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCE_ROWS", most)
    seen = []
    made = mixing._in_ranges
    monkeypatch.setattr(mixing, "_in_ranges", lambda slim, ranges: seen.append(made(slim, ranges)) or seen[-1])
    symbols = F.when(F.col("id") % 3 < F.when(F.col("id") < 20_000, 3).otherwise(1), "#$%&").otherwise("word word")
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), symbols.alias("text"), F.when(F.col("id") < 20_000, "hot").when(F.col("id") < 39_999, "mixed").alias("source")
    )
    got = mixing.mix_sources(docs, ranges=100)
    (slim,) = seen
    counts = {(r.source, r.range): r["count"] for r in slim.groupBy("source", "range").count().collect()}
    assert sum(counts.values()) == 40_000 and max(counts.values()) < 300
    for rows in slim.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("key", "range"))).alias("k")).collect():
        ranges = [r.range for r in rows.k]
        assert ranges == sorted(ranges)
    one = mixing.mix_sources(docs, ranges=1)
    assert got.exceptAll(one).isEmpty() and one.exceptAll(got).isEmpty()


def test_a_weight_column_decides_who_is_drawn(spark):
    """Weights of a score: the mean share that is taken follows them, the budgets don't; odd weights are the least."""
    weight = F.when(F.col("id") % 4 == 0, 5.0).when(F.col("id") % 4 == 1, 1.0).when(F.col("id") % 4 == 2, 0.2)
    docs = spark.range(8_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("one two three four "), F.col("id")).alias("text"), F.expr("if(id < 4000, 'a', 'b')").alias("source"), weight.alias("score")
    )
    rows = mixing.mix_sources(docs, share=0.5, weight=F.col("score")).collect()
    plain = mixing.mix_sources(docs, share=0.5).collect()
    assert {(r.source_size, r.target) for r in rows} == {(r.source_size, r.target) for r in plain}
    for source, target in {(r.doc_id < 4000, r.target) for r in rows}:
        own = [r for r in rows if (r.doc_id < 4000) == source]
        assert abs(sum(r.taken for r in own) - target) <= 1
        taken = [sum(r.taken for r in own if r.doc_id % 4 == k) / sum(r.size for r in own if r.doc_id % 4 == k) for k in range(4)]
        assert taken[0] >= taken[1] >= taken[2] > taken[3] + 0.02 and taken[3] < 0.05
        assert source or taken[0] > taken[1] + 0.1 > taken[2] + 0.2
        assert {r.weight for r in own if r.doc_id % 4 == 3} == {mixing.LEAST_WEIGHT}
