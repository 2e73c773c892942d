import json
import os
from datetime import UTC, datetime

from fileloom.jobs import run
from fileloom.jobs.compile import compile_text
from fileloom.operators import postings
from fileloom.operators.search import search

NOW = datetime(2027, 1, 15, 8)


def test_index_and_search_a_tree(spark, tmp_path):
    tree, now = tmp_path / "tree", NOW.replace(tzinfo=UTC).timestamp()
    for path, text, days in [
        ("docs/세금 2026.pdf", "(세금 신고)", 1), ("docs/old 세금.pdf", "(x)", 30), ("docs/note.txt", "세금 메모", 2), ("private/세금.txt", "비밀", 1),
        ("docs/node_modules/세금.txt", "no", 1), ("docs/.git/x.pdf", "no", 1),
    ]:
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
        os.utime(tree / path, (now - days * 86400,) * 2)
    run.index_tree(spark, str(tree), [str(tree / "docs")], str(tmp_path / "index"))
    found = run.search_index(spark, str(tmp_path / "index"), "지난주 세금 pdf", NOW).collect()
    assert [r.name for r in found] == ["세금 2026.pdf"] and "신고" in found[0].snippet.text
    found = run.search_index(spark, str(tmp_path / "index"), "세금", NOW, files_only=True, max_results=3).collect()
    assert [r.name for r in found] == ["세금.txt", "세금 2026.pdf", "old 세금.pdf"] and found[0].snippet is None
    hits = run.search_index(spark, str(tmp_path / "index"), "세금 | 메모 max:2", NOW)
    run.write_hits(hits, str(tmp_path / "out"), "json", bounded=True)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert [os.path.basename(x["path"]) for x in lines] == [r.name for r in hits.collect()] and len(lines) == 2


def test_an_index_is_joined_where_it_lies(spark, tmp_path):
    """Catalog and bodies share their buckets: with broadcasts off, no exchange lies below the join of a search of terms."""
    for k in range(40):
        (tmp_path / "t" / f"d{k % 4}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / f"d{k % 4}" / f"f{k}.txt").write_text(f"alpha number {k} " + ("beta" if k % 3 else "gamma"))
    root, out = str(tmp_path / "t"), f"file://{tmp_path}/index"
    run.index_tree(spark, root, [root], out, buckets=6)
    query, now = "alpha beta", datetime(2024, 1, 1)
    plain = search(spark.read.parquet(f"{out}/catalog"), spark.read.parquet(f"{out}/bodies"), compile_text(query, now), now)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        hits = run.search_index(spark, out, query, now)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Join") :]
        assert "Exchange" not in below and "Exchange" in plan 
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString().split("Join", 1)[1]
        found = [tuple(r) for r in hits.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert found == [tuple(r) for r in plain.collect()] and len(found) == 26


def scan_rows(df):
    """Rows that the scans of an executed query have read."""
    df.collect()
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        if "Scan parquet" in plan.nodeName():
            total += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        left += [children.apply(i) for i in range(children.size())]
    return total


def test_lookups_read_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "GROUP_BYTES", 64 << 10)
    words = spark.range(300_000).selectExpr("concat('w', lpad(cast(id % 30000 as string), 6, '0'), 'x') as word", "concat('p', id) as path")
    folder = f"file://{tmp_path}/postings"
    postings.write_postings(words, folder)
    table = spark.read.parquet(folder)
    assert table.count() == 300_000
    here, gone = postings.paths_for_word(table, "w012345x"), postings.paths_for_word(table, "w012345y")
    assert len(here.collect()) == 10 and gone.collect() == []
    # Between two words that are there, only the filters know that a word is not.
    assert scan_rows(here) <= 30_000 and scan_rows(gone) <= scan_rows(here)
