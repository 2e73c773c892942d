import os
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from fileloom.llm import quality, rules
from fileloom.llm.common import table
from tests.llm.test_decontam_jaccard import contaminated, groups
from tests.llm.test_rules_mixing import WORDS, counts, water


def kept_by_rules(text):
    n, chars, symbols, dup, _, base = counts(text)
    if base:
        return False
    stop = sum(w.lower() in rules.STOP_WORDS for w in WORDS.findall(text))
    lines = sum(bool(WORDS.search(x)) for x in text.split("\n"))
    return 1.5 <= chars / n <= 20 and symbols / n <= 0.25 and stop / n >= 0.03 and dup / lines <= 0.5


def test_run_against_stages_recomputed(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    documents = table(spark, folder, "documents")
    left = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    assert len({i for i, _, _ in left}) == len(left)
    sizes = [len(left)]

    model = quality.fit_quality(documents, table(spark, folder, "labels"))
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]

    def score(text):
        data = (text or "").encode()
        blocks = [data[i : i + quality.BLOCK] for i in range(0, len(data), quality.BLOCK)]
        good, bad = sum(max(len(packers[0].compress(b)), len(b) / 4) for b in blocks), sum(len(packers[1].compress(b)) for b in blocks)
        x = len(data) / (len(data) + 100) * (bad - good) / (bad + good) if data else 0.0
        return 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * x, -30, 30)))

    left = [d for d in left if score(d[1]) >= 0.3]
    sizes.append(len(left))
    left = [d for d in left if kept_by_rules(d[1])]
    sizes.append(len(left))
    left = [d for d, (i, n, c) in zip(left, groups(left)) if not n or i == c]
    sizes.append(len(left))
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    left = [d for d in left if not contaminated(d[1], items)[-1]]
    sizes.append(len(left))
    print("documents by stage", sizes)

    size, taken = {i: len(WORDS.findall(t or "")) for i, t, _ in left}, defaultdict(int)
    source, total = {i: s for i, _, s in left}, defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
    target = water(total)
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(size))
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert int(target[s] // total[s]) * r.size <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in total)


EDGES = "doc_id long, text string, lang string, source string, n_chars long, score double, _row string, weight double"


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, columns with clashing names, empty tables."""
    good = [f"The committee of the {w} said that it was to be held in the hall, and that all of them were there for the {k}th time. " for k, w in enumerate(["river", "town", "school", "union", "coast", "choir"])]
    long = " ".join(f"{g} Part {k} of the record is as it was." for k in range(3000) for g in good[:1])
    text = lambda k: " ".join(f"{g}{k} and {k + j}" for j, g in enumerate(good))
    rows = [(k, text(k), "en" if k % 3 else None, ["a", "b", None][k % 3], None, 0.5, "r", 1.0) for k in range(12)]
    rows += [(None, text(50), None, None, None, None, None, None), (20, None, "en", "a", 0, 1.0, "x", 1.0), (21, "", "en", "a", 0, 1.0, "x", 1.0), (22, long, "en", "b", 9, 0.0, "y", None)]
    rows += [rows[1], rows[1], (30, rows[2][1], "en", "z", 1, 0.1, "q", 2.0)]
    folder = str(tmp_path / "odd")
    spark.createDataFrame(rows, EDGES).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 12)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[4][1].split()[5:40])), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert len({r.doc_id for r in got}) == len(got)
    # Null and empty texts fail the rules, copies leave one of theirs, and the passage's document goes.
    assert not {20, 21, 30, 4} & {r.doc_id for r in got} and all(r.taken <= 2 * r.size for r in got)
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    none = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []
