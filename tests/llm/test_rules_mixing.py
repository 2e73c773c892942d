import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fileloom.llm import mixing, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the cat and the dog of a house in it is that he was for on are with as at by an or to be " * 3


def texts():
    rng = random.Random(3)
    some = [None, "", " \n\t ", "one", "one two", "a b c a b c", "\x85 x y z", "line\nline\n\nline", PROSE, PROSE + "#*$%&|<>" * 40]
    some += [" ".join(rng.choice("ab") for _ in range(n)) for n in (3, 49, 50, 400)]
    some += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) + " the of and in to is it a on at by", "x " * 30_000]
    some += ["\n".join(rng.choice(["the same line", "other é"]) for _ in range(40))]
    return some


def counts(text):
    ws = WORDS.findall(text or "")
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(ws)
    base = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), base


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "clash") for i, t, s in rows], SCHEMA)


def test_counts_against_brute_force(spark):
    rows = [(k, t, "s") for k, t in enumerate(texts())] + [(None, "null id", None), (3, "one", None), (3, "one", None)]
    got = rules.measure_rules(frame(spark, rows).repartition(3)).collect()
    want = Counter((i, *counts(t)) for i, t, _ in rows)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert kept[8] is False and not any(r.kept for r in got if r.base_failed)  # repeated prose


def test_kept_rows_keep_their_columns(spark):
    docs = frame(spark, [(1, " ".join(f"the w{k}" for k in range(60)), "s"), (2, "short", "s"), (3, None, "s")])
    out = rules.keep_by_rules(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    assert rules.keep_by_rules(docs.where("false")).collect() == []


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    free, left, target = set(names), share * sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("seed", range(2))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        source = rng.choice(["b", "a", "é", None, "hot", "hot", "hot", "B"])
        rows.append((k, rng.choice([None, "", "w " * rng.randrange(1, 50 if k % 60 else 3000)]), source))
    rows += [rows[5], rows[5], (None, "x y z", "a")]
    docs = frame(spark, rows).repartition(4)
    got = mixing.mix_sources(docs, ranges=8).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORDS.findall(t or ""))
    target = water(size)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken >= int(r.target // r.source_size if r.source_size else 0) * r.size  # complete epochs first
    for s in size:
        own = sum(3 for i, t, x in rows if i is None and x == s)  # the null id is not in the join
        assert abs(taken[s] - target[s]) <= 1 + 2 * own
    again = mixing.mix_sources(docs.repartition(7), ranges=8)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, mixing.mix_sources(docs, ranges=8).collect()))


def test_mix_prefers_quality_and_takes_empty_tables(spark):
    rows = [(k, "word " * 20 if k % 2 else "#$%& " * 20, "s") for k in range(400)]
    got = mixing.mix_sources(frame(spark, rows), share=0.25).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t"))
    found = {r.odd: r.t for r in got.collect()}
    assert found[1] > 2 * found[0]
    assert mixing.mix_sources(frame(spark, []).where("false")).collect() == []
    assert [r.taken for r in mixing.mix_sources(frame(spark, [(1, None, None)])).collect()] == [0]
