"""Single operators over a few hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fileloom.jobs import sinks
from fileloom.jobs.compile import compile_query, compile_text
from fileloom.operators import rank
from fileloom.operators.search import search
from fileloom.schema import BODIES, CATALOG

NOW = datetime(2027, 1, 15, 8)
H = timedelta(hours=1)

ROWS = [
    # id, name, path, size, age, is_dir, attributes
    (1, "README", r"C:\docs\README", 10, 1 * H, False, 0),
    (2, ".gitignore", r"C:\docs\.gitignore", 0, 36 * H, False, 2),
    (3, "x.tar.gz", r"C:\docs\deep\a\x.tar.gz", 2048, 72 * H, False, 1),
    (4, "Report-final.pdf", r"C:\docs\Report-final.pdf", 5000, 240 * H, False, 3),
    (5, "alpha-report.txt", r"C:\docs\alpha-report.txt", 1024, 2 * H, False, 0),
    (6, "docs", r"C:\docs", 0, 500 * H, True, 0),
    (7, "보고서.한글", r"C:\UsersOld\보고서.한글", 77, 9600 * H, False, 4),
    (8, "foo.", r"D:/mixed\foo.", 5, -1 * H, False, 0),
    (9, "REPORT.pdf", r"C:\other\REPORT.pdf", 1024, 6 * H, False, 0),
]
BODY = {
    1: "Read me first. er_x er-y\nsecond line",
    4: "the final 세금 report " + "가나다" * 60 + " needle " + "é" * 100,
    5: "er alone; 100% of a_b",
    9: "nothing here",
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, None, n, p, s, NOW - a, d, t) for i, n, p, s, a, d, t in ROWS]
    catalog = spark.createDataFrame(rows, CATALOG).repartition(3)
    paths = {r[0]: r[2] for r in ROWS}
    return catalog, spark.createDataFrame([(paths[i], b) for i, b in BODY.items()], BODIES)


def ids(tables, text, free=False, **options):
    q = compile_text(text, NOW) if free else compile_query(text, NOW)
    return [r.id for r in search(*tables, q, NOW, **options).collect()]


CASES = {
    "ext:PDF": {4, 9}, "ext:": set(range(1, 10)), "ext:gz;한글": {3, 7}, "pic:": set(), "zip:": {3}, "doc:": {4, 5, 9},
    "size:1kb": {5, 9}, "size:>=1kb size:<2kb": {5, 9, 1, 2, 6, 7, 8}, "empty:": {2, 6}, "empty:yes size:>1kb": {3, 4},
    "len:4": {6, 8}, "extlen:9": {2}, "extlen:2": {3, 7}, "extlen:0": {1, 6, 8}, "noext:": {1, 2}, "dot:": {2},
    "depth:1": {6}, "depth:>=4": {3}, "depth:2 D": {1, 2, 4, 5, 7, 8, 9},
    "dm:today": {1, 5, 8, 9}, "dm:yesterday": {2}, "dm:lastweek": {1, 2, 3, 5, 8, 9}, "dm:<2026-01-01": {7},
    "file: folder:": set(), "folder:": {6}, "file:": {1, 2, 3, 4, 5, 7, 8, 9}, "attrib:RH": {4}, "attrib:R|S": {3, 4, 7},
    "attrib:D": {6}, "hidden:": {2, 4}, "readonly: hidden:": {4}, "parent:c:/docs/": {1, 2, 4, 5}, r"parent:C:\ ": {6},
    "path:DOCS/deep": {3}, r"root:C:\users": {7}, "root:d:": {8},
    "report": {4, 5, 9}, "case: report": {4, 5}, "case: REPORT": {9}, "세금": {4}, '"the final"': {4},
    "ww: report": {4, 5, 9}, "ww: er": {1, 5}, "ww: 보고": set(), "ww: 보고서": {7},
    "*.pdf": {4, 9}, "r?port*": {4, 9}, "rep*pdf": {4, 9}, "*100%*a_b*": {5}, "*100_*": set(),
    "regex:^rep.*f$": {4, 9}, "regex:e$": {1, 2, 9}, "regex:a+b": set(), "regex:rs*t": {1, 4, 5, 9}, "regex:*tar": {3},
    "startwith:rep": {4, 9}, "endwith:.PDF": {4, 9}, "stem:x.tar": {3}, "stem:gitignore": {2}, "stem:pdf": set(),
    "content:report": {4}, "body:er|nothing": {1, 5, 9}, "content:nosuch": set(),
    "n:report": {4, 9}, "n:r": {1, 3, 4, 5, 9, 2}, "n:docs": {6},
    "report final": {4}, "alpha|gz": {3, 5}, "alpha | gz": {3, 5}, "startwith:d:|readme": {1, 8},
    "report !final": {5, 9}, "report ! endwith:.txt": {4, 9}, "!stem:report": {1, 2, 3, 6, 7, 8},
    "": set(range(1, 10)), "!docs": {7, 8, 9},
}


@pytest.mark.parametrize("text", list(CASES))
def test_operators(tables, text):
    assert set(ids(tables, text)) == CASES[text]


def test_narrowing_can_be_left_out(tables):
    assert set(ids(tables, "n:report", narrowing=False)) == {4, 5, 9}


def test_order_and_limits(tables):
    assert ids(tables, "report") == [9, 5, 4]  # all three by name; 9 is also the exact stem
    assert ids(tables, "sort:size count:3") == [4, 3, 9]
    assert ids(tables, "sort:date count:2") == [8, 1]
    assert ids(tables, "sort:name count:3") == [2, 1, 9]
    assert ids(tables, "report count:0") == []
    assert search(*tables, compile_query("report sort:size", NOW), NOW).agg(F.max("score")).first()[0] == 0.0


def test_scores(tables):
    rows = {r.id: r for r in search(*tables, compile_query("report", NOW), NOW).collect()}
    assert rows[9].score == pytest.approx(1000 + 200 + 50 * (1 - 6 / 168))
    assert rows[4].score == pytest.approx(1000 + 10)
    assert (rows[4].name_match, rows[4].path_match, rows[4].content_match) == (True, True, True)
    (future,) = search(*tables, compile_query("foo", NOW), NOW).collect()
    assert future.score == 1000 + 200  # changed after now: no boost
    assert not any(r.name_match for r in search(*tables, compile_query("ext:pdf", NOW), NOW).collect())


def test_snippets_cut_at_bytes_and_highlight(tables):
    from fileloom.functions.text import snippet_of

    for text in ("needle", "세금 report", "final|needle"):
        q = compile_query(text, NOW)
        rows = [r for r in search(*tables, q, NOW).collect() if r.snippet is not None]
        assert rows
        for r in rows:
            want = snippet_of(BODY[r.id], q.terms)
            assert r.snippet.text == want["text"]
            assert [h.asDict() for h in r.snippet.highlights] == want["highlights"]
            raw = r.snippet.text.encode()
            assert all(raw[h.start : h.end].decode().lower() in [t.lower() for t in q.terms] for h in r.snippet.highlights)
        limited = search(*tables, compile_query(text + " count:1", NOW), NOW).collect()
        assert limited[0].snippet == search(*tables, q, NOW).collect()[0].snippet


def test_free_text(tables):
    assert ids(tables, "세금 pdf", free=True) == [4]
    assert ids(tables, "어제", free=True) == [2]


def test_sinks_and_job_limits(tables, tmp_path):
    import json

    q = compile_query("report count:3", NOW)
    hits = rank.with_rank(search(*tables, q, NOW), q)
    sinks.write_json(hits, str(tmp_path / "json"), bounded=True)
    lines = [json.loads(x) for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()]
    assert [x["path"] for x in lines] == [r"C:\other\REPORT.pdf", r"C:\docs\alpha-report.txt", r"C:\docs\Report-final.pdf"]
    assert lines[0]["highlights"] == [] and lines[2]["highlights"]
    sinks.write_paths(hits, str(tmp_path / "paths"))
    assert sinks.count_hits(hits).first()[0] == 3
    assert [r.id for r in rank.job_limits(hits, files_only=True, max_results=2).collect()] == [9, 5]
    with pytest.raises(ValueError):
        rank.job_limits(hits, True, True)


def test_one_and_many_partitions_agree(tables):
    catalog, bodies = tables
    q = compile_query("e !zzz", NOW)
    one = search(catalog.coalesce(1), bodies.coalesce(1), q, NOW).collect()
    assert one == search(catalog.repartition(7), bodies.repartition(5), q, NOW).collect()
