"""The array form of the word index against its long form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fileloom.operators import blocks, postings


def test_no_row_a_word_is_shuffled(spark):
    bodies = spark.createDataFrame([("a", "x y"), ("b", "y")], "path string, body string")
    plan = blocks.build_blocks(bodies, 256)[1]._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and plan.count("Exchange hashpartitioning(chunk") == 1


def test_written_blocks_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(body):
        made.add(1)
        return body

    bodies = spark.createDataFrame([(f"p{k}", f"x w{k}") for k in range(300)], "path string, body string")
    numbers = blocks.build_blocks

    def counted(df, span):
        of, found = numbers(df, span)
        return of, found.withColumn("word", seen.asNondeterministic()("word"))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(blocks, "build_blocks", counted)
        blocks.write_blocks(bodies, str(tmp_path / "index"), 256)
    found = blocks.read_blocks(spark, str(tmp_path / "index"))
    assert made.value == found[1].count() == 302
    assert [r.path for r in blocks.paths_with_all_words(*found, ["x", "w7"]).collect()] == ["p7"]


@pytest.mark.parametrize("span", [256, 1000, 1 << 16])
def test_spans_of_several_chunks(spark, span, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 70)
    test_blocks_against_the_long_form(spark, span)


@pytest.mark.parametrize("span", [4, 64, 1 << 16])
def test_blocks_against_the_long_form(spark, span):
    rng = random.Random(span)
    vocabulary = ["the", *[f"w{k}" for k in range(12)], "Über", "rare"]
    rows = [(f"C:\\d{rng.randrange(9)}\\f{k:04d}", " ".join(["The"] + rng.choices(vocabulary[1:-1], k=rng.randrange(0, 9)) + ["rare"] * (k % 97 == 5))) for k in range(400)]
    rows += [("a", None), ("b", ""), ("c", "- -")]
    bodies = spark.createDataFrame(rows, "path string, body string").repartition(5)
    numbers, found = blocks.build_blocks(bodies, span)
    of = {r.n: r.path for r in numbers.collect()}
    assert [of[n] for n in sorted(of)] == sorted(p for p, _ in rows) and sorted(of) == list(range(403))
    got = set()
    for r in found.collect():
        ns = (r.first + np.cumsum(r.deltas)).tolist()
        assert len(ns) == r.many <= span and ns == sorted(set(ns)) and ns[-1] == r.last and {n // span for n in ns} == {r.block}
        got |= {(r.word, of[n]) for n in ns}
    long = postings.build_postings(bodies)
    assert got == {tuple(r) for r in long.collect()}
    # A word that every body has is split over the spans.
    assert found.where("word = 'the'").count() >= 400 // span
    for wanted in (["THE"], ["the", "w1", "w2"], ["über", "w3", "the", "w3"], ["rare", "the"], ["rare", "w1", "w5"], ["nowhere", "the"], []):
        want = sorted(r.path for r in postings.paths_for_all_words(long, wanted).collect())
        assert sorted(r.path for r in blocks.paths_with_all_words(numbers, found, wanted).collect()) == want


def test_blocks_of_no_bodies(spark):
    numbers, found = blocks.build_blocks(spark.createDataFrame([], "path string, body string"))
    assert numbers.collect() == [] and found.collect() == [] and blocks.paths_with_all_words(numbers, found, ["a"]).collect() == []
