import io
import os
import tracemalloc
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fileloom.functions import derive, text
from fileloom.jobs import run
from fileloom.jobs.queries import ORACLE_SQL, QUERIES
from fileloom.operators import postings
from fileloom.sources import extract, listing


@pytest.mark.parametrize(
    "path, ext, stem, ext_len, depth, parent",
    [
        (r"C:\a\b\c.TXT", "txt", "c", 3, 3, "c:\\a\\b"), (r"C:\x", None, "x", 0, 1, "c:"), (r"C:\.gitignore", None, ".gitignore", 9, 1, "c:"),
        ("/u//v/x.tar.gz", "gz", "x.tar", 2, 3, "\\u\\v"), (r"C:\foo.", "", "foo", 0, 1, "c:"), ("C:\\", None, "C:", 0, 0, None),
        (r"\\srv\share\a", None, "a", 0, 1, "\\srv\\share"), (r"C:\.\..\b", None, "b", 0, 2, "c:\\.\\.."),
    ],
)
def test_derived(spark, path, ext, stem, ext_len, depth, parent):
    rows = spark.createDataFrame([(path,)], "path string").select("path", derive.last_component(F.col("path")).alias("name"))
    rows = rows.withColumns({"is_dir": F.lit(False), "attributes": F.lit(0)})
    (r,) = derive.with_derived(rows).collect()
    assert (r.ext, r.stem, r.ext_len, r.depth, r.parent_norm) == (ext, stem, ext_len, depth, parent)
    assert r.path_norm == derive.normal_text(path)


MARKUP = [
    "<p>a &amp; b</p>", "a&lt;b&gt;c", "x<script>var a = 1 > 0;</script>y", "&copy;&#65;&#x42;&nbsp;z", "AT&T <b>x</b>; y",
    "<a <b> c", "&amp;lt;", "&am&amp;x;", "", "a > b", "<p", "&#xD800;&#99999999;k", "&;q", "  \u00a0 a \u2003 b ",
]


def test_markup_ways_agree(spark):
    df = spark.createDataFrame([(k, m) for k, m in enumerate(MARKUP)], "k int, m string")
    got = {r.k: r.t for r in text.with_markup_text(df, "m", "t").collect()}
    assert got == {k: text.markup_text(m) for k, m in enumerate(MARKUP)}
    assert got[4] == "AT y" and got[6] == "&lt;" and got[2] == "x var a = 1 0; y"


@pytest.mark.parametrize("html", ["<title>der&am</title><style>p{m:0}</style><script>var t='</p>';track(1);</script>x", "a&&&#65;b", "AT&T<b>x</b>;y", "&am&amp;x;", "a&lt</p>;b", None])
def test_registered_markup_as_its_sql(spark, tmp_path, html):
    folder = str(tmp_path)
    spark.createDataFrame([(1, html), (2, "<p>a &amp; b")], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    pages = duckdb.sql(f"SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")  # noqa: F841
    want = duckdb.sql(ORACLE_SQL["S4b_X1_markup_text"]).fetchall()
    assert sorted(map(tuple, QUERIES["S4b_X1_markup_text"](spark, folder).collect())) == sorted(want)


def test_tags_in_an_open_entity(spark):
    """The searched tool's own way, which extraction keeps: a tag in an open entity leaves its space."""
    df = spark.createDataFrame([("der&am</title>track();x",)], "m string")
    assert text.with_markup_text(df, "m", "t").first().t == "der x"
    assert text.with_markup_text(df, "m", "t", tags_first=True).first().t == "derx"


def _office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts:
            z.writestr(n, t)
    return out.getvalue()


def test_every_file_is_read_once(spark):
    rows = spark.createDataFrame([("a", "pdf", b"(x)"), ("b", "html", b"&#65;")], "path string, ext string, content binary")
    plan = extract.extract_bodies(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("helper(") == 2


@pytest.mark.parametrize("ext", ["pdf", "docx", "txt"])
def test_bodies_are_made_in_pieces(ext):
    """A worker holds a piece of a batch's bodies, not all of them."""
    plain = "word \u00e9 " * 4_000
    made = {"pdf": f"%PDF ({plain})".encode(), "docx": _office([("word/document.xml", f"<w>{plain}</w>")]), "txt": ("\ufeff" + plain).encode("utf-16-le")}
    contents = pa.array([made[ext], None] * 400, pa.binary())
    tracemalloc.start()
    try:
        rows = pieces = 0
        for part in extract.bodies_in_pieces(iter([(pa.array([ext] * 800), contents)])):
            rows, pieces = rows + len(part), pieces + 1
            assert all(v.is_valid == (k % 2 == 0) for k, v in enumerate(part, rows - len(part)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # All bodies are 22 MB or more.
    assert rows == 800 and pieces > 5 and peak < 8e6


@pytest.mark.parametrize("data", [b"", b"(", b"(a", b"(a\\", b"(a\\)b", b"a)(b(c)d)(e)", b"(\\\\)x", b"(a\nb)\xff\xc2\x85c", b"((((" * 9, b"(" + b"\\x" * 50_000])
def test_pdf_literals(data):
    out, at = "", data.find(b"(")
    while at >= 0:
        at, literal = at + 1, b""
        while at < len(data) and data[at : at + 1] != b")":
            at += data[at : at + 1] == b"\\" and at + 1 < len(data)
            literal, at = literal + data[at : at + 1], at + 1
        out, at = out + " " + literal.decode("latin-1"), data.find(b"(", at + 1)
    runs = "".join(c for c in data.decode("utf-8", "replace") if c != "\ufffd" and not (c < " " or "\x7f" <= c <= "\x9f"))
    assert extract.pdf_text(data) == " ".join(f"{out} {runs}".split())


def test_extract(spark):
    files = {
        "bom.txt": b"\xef\xbb\xbfhello", "bad.txt": b"a\xff", "le.md": "\ufeffab\uac00".encode("utf-16-le"), "be.md": b"\xfe\xff\x00a\xd8\x00",
        "a.html": b"<p>x</p>&#65;", "bom.xml": b"\xef\xbb\xbf<a>y</a>", "r.rtf": rb"{\rtf1\ansi a\\b {\b bold}\par end}",
        "d.pdf": b"%PDF (lit\\)eral) \x01\xea\xb0\x80\nx (open", "o.docx": _office([("word/document.xml", "<w>one</w>"), ("x.xml", "no")]),
        "s.xlsx": _office([("xl/worksheets/sheet1.xml", "<v>1</v>"), ("xl/sharedStrings.xml", "<t>s</t>")]),
        "p.pptx": _office([("ppt/slides/slide1.xml", "<t>p</t>")]), "broken.docx": b"PK", "z.bin": b"x", "empty.txt": b"",
    }
    rows = [(n, n.rsplit(".", 1)[1], d) for n, d in files.items()]
    df = spark.createDataFrame(rows, "path string, ext string, content binary")
    got = {r.path: r.body for r in extract.extract_bodies(df).collect()}
    assert got == {
        "bom.txt": "hello", "le.md": "ab\uac00", "be.md": "a\ufffd", "a.html": "x A",
        "bom.xml": "\ufeff y", "r.rtf": "1a\\b boldend", "d.pdf": extract.pdf_text(files["d.pdf"]), "o.docx": " one",
        "s.xlsx": " 1 s", "p.pptx": " p", "empty.txt": "",
    }
    assert got["d.pdf"].startswith("lit)eral open %PDF (lit\\)eral) \uac00x (open")


def test_listing(spark, tmp_path):
    for p in ("a/b/x.txt", "a/.git/config", "a/NODE_modules/y.js", "a/Target/z.txt", ".hidden", "target/q"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("data")
    os.utime(tmp_path / ".hidden", (1000, 1000))
    entries = listing.list_tree(spark, str(tmp_path))
    catalog = {r.path[len(str(tmp_path)) + 1 :]: r for r in listing.catalog_of_entries(entries, 10).collect()}
    assert set(catalog) == {"a", "a/b", "a/b/x.txt", "a/.git", "a/NODE_modules", "a/Target", "a/Target/z.txt", ".hidden", "target"}
    assert sorted(r.id for r in catalog.values()) == list(range(10, 19))
    assert catalog["a"].parent_id is None and catalog["a/b/x.txt"].parent_id == catalog["a/b"].id
    assert catalog["a"].size == 0 and catalog[".hidden"].size == 4 and catalog[".hidden"].modified.timestamp() == 1000
    table = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*")], "path string")
    kept = {r.path[len(str(tmp_path)) + 1 :] for r in listing.outside_skipped(table, str(tmp_path)).collect()}
    assert kept == set(catalog)
    gated = listing.body_gate(
        derive.with_derived(listing.catalog_of_entries(entries)), [str(tmp_path / "a")], extract.EXTRACTABLE
    )
    bodies = extract.extract_bodies(extract.read_files(spark, gated))
    assert {os.path.basename(r.path): r.body for r in bodies.collect()} == {"x.txt": "data", "z.txt": "data"}


def a_tree(root):
    files = [
        "a/b/x.txt", "a/.git/config", "a/NODE_modules/y.js", "a/Target/z.txt", ".hidden", "target/q", ".env.txt", "_under.txt", "_d/in.txt", "_d/_e/f.md",
        "a/with space %41#?.txt", "a/ünï.md", ".venv/lib/x.py",
    ]
    for p in files:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(f"text of {p}")
    (root / "empty" / ".deep").mkdir(parents=True)
    (root / "link").symlink_to(root / "a")
    os.utime(root / ".hidden", (1000, 1000))


def test_stores_are_listed_like_mounts(spark, tmp_path):
    a_tree(tmp_path)
    mounted = listing.list_tree(spark, str(tmp_path)).collect()
    stored = listing.list_store(spark, f"file://{tmp_path}/").collect()
    own = lambda rows, root: {(r.parent_path[len(root) :], r.path[len(root) :], r.name, r.size * (r.name != "link"), r.modified.replace(microsecond=0) if r.name != "link" else None, r.is_dir) for r in rows}
    assert own(stored, f"file://{tmp_path}") == own(mounted, str(tmp_path)) and len(stored) == len(mounted)
    names = {r.path[len(f"file://{tmp_path}/") :] for r in stored}
    assert {"_d/_e/f.md", ".env.txt", "a/.git", ".venv", "empty/.deep", "link"} <= names
    assert not any(n.startswith(("a/.git/", "a/NODE_modules/", ".venv/", "link/", "target/")) for n in names)
    assert listing.list_store(spark, f"file://{tmp_path}/empty/.deep").collect() == []


def test_indexes_of_mounts_and_stores_are_the_same(spark, tmp_path):
    a_tree(tmp_path / "tree")
    found = {}
    for mounted, root in ((True, f"{tmp_path}/tree"), (False, f"file://{tmp_path}/tree")):
        out = f"file://{tmp_path}/index-{mounted}"
        run.index_tree(spark, root, [f"{root}/a", f"{root}/_d", f"{root}/.env.txt"], out, mounted=mounted)
        tables = {t: spark.read.parquet(f"{out}/{t}").collect() for t in ("catalog", "bodies", "postings")}
        cut = len(root) + 1
        found[mounted] = (
            {(r.id, r.parent_id, r.path[cut:], r.is_dir, r.ext) for r in tables["catalog"]},
            {(r.path[cut:], r.body) for r in tables["bodies"]},
            {(r.word, r.path[cut:]) for r in tables["postings"]},
        )
    assert found[True] == found[False]
    bodies = dict(found[False][1])
    assert bodies == {p: f"text of {p}" for p in ("a/b/x.txt", "a/Target/z.txt", "a/with space %41#?.txt", "a/ünï.md", "_d/in.txt", "_d/_e/f.md", ".env.txt")}


@pytest.mark.parametrize("mounted", [True, False])
def test_files_outside_the_gate_are_not_opened(spark, tmp_path, mounted):
    """A file beyond the gate's size that nobody may read, and one that is gone when it is read."""
    for name, size in (("a.txt", 10), ("big.txt", 5000), ("gone.txt", 10)):
        (tmp_path / name).write_text("x" * size)
    (tmp_path / "big.txt").chmod(0)
    root = str(tmp_path) if mounted else f"file://{tmp_path}"
    entries = listing.list_tree(spark, root) if mounted else listing.list_store(spark, root)
    gated = listing.body_gate(derive.with_derived(listing.catalog_of_entries(entries)), [root], extract.EXTRACTABLE, most=100).cache()
    assert gated.count() == 2
    (tmp_path / "gone.txt").unlink()
    # Were it opened, it would be read all the same by root: so it is made unreadable by being a folder now.
    (tmp_path / "big.txt").unlink()
    (tmp_path / "big.txt").mkdir()
    files = extract.read_files(spark, gated) if mounted else extract.read_store(spark, gated, root)
    assert [(os.path.basename(r.path), bytes(r.content)) for r in files.collect()] == [("a.txt", b"x" * 10)]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_tasks_read_even_shares_of_bytes(spark):
    """A tenth of the files has nearly all bytes, in one stretch of the order of paths."""
    rows = [(f"/f{k:05d}", "txt", 20_000_000 if 3000 <= k < 3400 else 10_000) for k in range(4000)]
    dealt = extract.by_even_bytes(spark.createDataFrame(rows, "path string, ext string, size long"), tasks=20)
    size = {p: n for p, _, n in rows}
    per_task = dealt.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.collect_list("path").alias("p")).collect()
    assert sorted(p for r in per_task for p in r.p) == sorted(size)
    shares = sorted(sum(size[p] + extract.OPEN_BYTES for p in r.p) for r in per_task)
    assert len(shares) == 20 and shares[-1] <= 1.1 * shares[10] and shares[0] >= 0.9 * shares[10]
    assert extract.by_even_bytes(spark.createDataFrame([], "path string, ext string, size long")).collect() == []


def test_postings_follow_bodies(spark):
    bodies = spark.createDataFrame([("a", "One two, TWO"), ("b", "two-three İx ΑΣ"), ("c", "")], "path string, body string")
    index = postings.build_postings(bodies)
    assert sorted(map(tuple, index.collect())) == sorted([("one", "a"), ("two", "a"), ("two", "b"), ("three", "b"), ("ix", "b"), ("ασ", "b")])
    assert [r.path for r in postings.paths_for_word(index, "One").collect()] == ["a"]
    assert [r.path for r in postings.paths_for_all_words(index, ["two", "three", "two"]).collect()] == ["b"]
    changes = spark.createDataFrame([(1, "a", "x"), (2, "a", "four"), (1, "b", None), (3, "d", "two")], "seq int, path string, body string")
    now = postings.upsert_bodies(bodies, changes)
    assert {tuple(r) for r in now.collect()} == {("a", "four"), ("c", ""), ("d", "two")}
    again = postings.upsert_postings(index, changes)
    assert sorted(again.collect()) == sorted(postings.build_postings(now).collect())
