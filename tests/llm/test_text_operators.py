import base64
import hashlib
import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from fileloom.llm import html, license_texts, licenses, quality, tokens, urls, warc

DOCS = "doc_id long, text string, label string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


# Licences


def test_licenses(spark):
    mit = next(t for t, n in license_texts.LICENSES.items() if n == "MIT")
    shouting = "Copyright (c) 1999 A. Nyone\n\n" + mit.upper().replace("\n", "   \n") + "\n© 2000 Other"
    rows = [
        (1, shouting), (2, mit.replace("sublicense", "sublicense,").replace("authors", "authors!")), (3, mit + " more"), (4, None), (5, ""),
        (6, "text\nReleased under the MIT Licence.\nALL RIGHTS RESERVED\nReleased under the MIT license"), (7, "(c) 2020 x"), (6, "again"), (None, mit),
        (8, "All rights reserved. " * 3),
    ]
    got = {(r.doc_id, r.license, r.notices) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {
        (1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "MIT,all-rights-reserved"), (6, None, ""),
        (7, None, ""), (None, "MIT", ""), (8, None, ""),
    }
    out = licenses.scan_licenses(docs(spark, [(4, None), (5, "--"), (7, "© 1")])).select("digest").distinct().collect()
    assert [r.digest for r in out] == [licenses.text_digest("")]
    assert licenses.scan_licenses(docs(spark, [])).collect() == []


# Quality


def corpus(n, seed=1):
    rng = random.Random(seed)
    prose = "the of and to in that house river morning walked quietly under old bridge while rain".split()
    rows = []
    for k in range(n):
        good = rng.random() < 0.8
        ws = [rng.choice(prose) for _ in range(rng.randrange(20, 200))]
        rows.append((k, " ".join(ws) if good else " ".join(f"{w.upper()}!!$$" for w in ws), int(good)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = corpus(600)
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (5, rows[5][1])])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = quality.score_quality(table, labels).collect()
    assert len(got) == 603 and got[0].asDict().keys() >= {"doc_id", "held_out", "score", "predicted"}
    by_id = {r.doc_id: r for r in got}
    for i, r in by_id.items():
        if i is not None:
            assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(by_id[i].predicted, q) for i, _, q in rows if by_id[i].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert by_id[None].score == by_id[9000].score and by_id[9000].predicted == 1
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted for r in got)


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs(spark, [(1, "a"), (2, None)]), labels).collect()} == {0.5}
    assert quality.score_quality(docs(spark, []), labels).collect() == []


def test_held_out_labels_are_not_learnt_from(spark):
    rows = corpus(200)
    table = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(table, labels) == quality.fit_quality(table, turned)


def test_scores_are_of_the_compressed_sizes(spark):
    """The operator's scores against plain calls of the compressor, with the model that it fits."""
    rows = corpus(200)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(900, "x" * 20_000), (901, None)])
    model = quality.fit_quality(table, labels)
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score_quality(table, labels).collect():
        data = ({**{i: t for i, t, _ in rows}, 900: "x" * 20_000}.get(r.doc_id) or "").encode()
        blocks = [data[i : i + quality.BLOCK] for i in range(0, len(data), quality.BLOCK)]
        good = sum(max(len(packers[0].compress(b)), len(b) / 4) for b in blocks)
        bad = sum(len(packers[1].compress(b)) for b in blocks)
        x = [1.0, 0.0]
        if data:
            known = len(data) / (len(data) + 100)
            x = [1.0, known * (bad - good) / (bad + good)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights)))), abs=1e-9)
    bounded = quality.fit_quality(table, labels, all_bytes=1)
    assert bounded.weights[1:] == (0.0,)


def test_held_out_rows_of_the_given_tables(spark):
    """The score by compressed sizes alone, against the labels that it has not seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    print("held-out area under the curve", above, len(good), len(bad))
    assert above > 0.99 and sum(r.predicted for r in got if r.quality == 1) >= 0.99 * len(good)


# Token counts


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.read_ranks(tokens.VOCABULARY))


def test_edits_against_recounts(counter):
    rng = random.Random(2)
    alphabet = "ab c  \n\n'llsd 12.,!é\t　"
    for k in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 300, 6000])))
        tree = tokens.Tree.build(counter, text)
        for _ in range(4):
            start, cut = rng.randrange(0, len(text) + 3), rng.choice([0, 1, 3, 30, 500])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 40, 20_000 if k % 60 == 0 else 5])))
            encoded = tree.edit(start, start + cut, new)
            text = text[:start] + new + text[min(len(text), max(start, start + cut)) if start < len(text) else len(text) :]
            assert tree.text == text
            assert (tree.n_tokens, tree.n_chars) == (len(counter.encoding.encode_ordinary(text)), len(text))
            assert tree.n_pieces == len(counter.split(text)) and encoded <= tree.n_pieces + 2
    tree = tokens.Tree.build(counter, "word and more " * 20_000)
    assert tree.edit(100_000, 100_004, "other") < 600


def test_a_border_is_judged_by_what_follows_it(counter):
    """After a cut that empties many leaves, the text that follows is several leaves away."""
    text = "w" * 3 + " w" * (64 * 18 - 1) + " w!'" + "s" + " w" * 700
    tree = tokens.Tree.build(counter, text)
    at = text.index("!'")
    start = 200
    for cut in ((start, at), (start, start + 1)):
        tree.edit(cut[0], cut[1], "" if cut[1] == at else "a")
        text = text[: cut[0]] + ("" if cut[1] == at else "a") + text[cut[1] :]
        assert (tree.text, tree.n_tokens, tree.n_pieces) == (text, len(counter.encoding.encode_ordinary(text)), len(counter.split(text)))


@pytest.mark.parametrize("leaf", [2, 4, 64])
def test_many_edits_with_leaves_of_any_size(counter, leaf, monkeypatch):
    monkeypatch.setattr(tokens, "LEAF", leaf)
    rng = random.Random(leaf)
    for alphabet in ("a's! ", "a  \n'l1", "'rev "):
        for _ in range(120):
            text = "".join(rng.choice(alphabet) for _ in range(rng.choice([5, 40, 400, 30 * leaf])))
            tree = tokens.Tree.build(counter, text)
            for _ in range(12):
                start = rng.randrange(len(text) + 1)
                end = start + rng.choice([0, 1, 2, 9, 40, len(text) // 2])
                new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 0, 1, 2, 30])))
                tree.edit(start, end, new)
                text = text[:start] + new + text[min(end, len(text)) :]
                want = text, len(counter.encoding.encode_ordinary(text)), len(counter.split(text))
                assert (tree.text, tree.n_tokens, tree.n_pieces) == want


def test_counts_and_stored_trees_agree(spark, counter):
    texts = [(k, " ".join(f"Word{j % 7},  don't" for j in range(k * 40))) for k in range(8)] + [(100, None), (101, ""), (None, "no id"), (102, "twice"), (102, "twice")]
    table = docs(spark, texts)
    rows = tokens.count_documents(table).collect()
    got = {r.doc_id: r for r in rows}
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in texts)
    table = table.where("doc_id is not null and doc_id <> 102")
    edits = tokens.derived_edits(table).select("doc_id", F.posexplode("edits").alias("seq", "e")).select("doc_id", "seq", "e.*")
    stored = tokens.apply_edits(tokens.token_trees(table), edits)
    for r in stored.collect():
        assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) == got[r.doc_id].edited_tokens
        assert sum(r.leaf_chars) == len(r.text) == got[r.doc_id].edited_chars and sum(r.leaf_tokens) == r.n_tokens
    for i, t in texts:
        assert got[i].n_tokens == len(counter.encoding.encode_ordinary(t or ""))
    assert (got[100].n_tokens, got[100].edited_tokens) == (0, 0)
    # A stored tree takes further edits.
    again = stored.drop("encoded")
    more = spark.createDataFrame([(3, 1, 10, 25, "new 'll"), (3, 0, 0, 0, None), (None, 0, 0, 1, "x"), (77, 0, 0, 1, "x")], "doc_id long, seq int, start int, end int, replacement string")
    (r,) = tokens.apply_edits(again, more).collect()
    before = next(x.text for x in stored.collect() if x.doc_id == 3)
    assert r.text == before[:10] + "new 'll" + before[25:] and r.n_tokens == len(counter.encoding.encode_ordinary(r.text))
    assert tokens.count_documents(docs(spark, [])).collect() == []


# Pages


PAGES = "page_id long, url string, html string, text string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>Head &amp; &#8364;</h1>
<p><b>Bold<br>line   two<p>Next&nbsp;one <a href="x">link</a>.</p><aside>side</aside><form><p>Send</p></form><ul><li>a<li>b</ul>
<div class="comments"><p>First!</p></div></article><footer>foot</footer>"""


def page(k, body="", notice="We use tokens"):
    return f"<html><body><div>{notice}</div><div class=x><p>Story {k} begins here, long enough.</p><p>It ends, {k * 7}.</p>{body}</div><p>Imprint</p></body></html>"


def test_pages(spark):
    rows = [(1, "http://a.example.org/1", PAGE), (2, None, None), (3, "http://a.example.org/2", ""), (4, "x", "plain &lt;text"), (1, "http://a.example.org/1", PAGE)]
    rows += [(10 + k, f"http://plain.example.org/{k}", page(k, "<p>more</p>" * (k % 3))) for k in range(6)]
    rows += [(30, "http://huge.example.org/", "<article>" + "<p>word word</p>" * 20_000 + "</article>")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    got = html.extract_pages(table).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by_id[1].text == "Head & €\n\nBold line two\n\nNext one link.\n\na\n\nb"
    assert (by_id[2].text, by_id[3].text, by_id[4].text) == ("", "", "plain <text")
    assert by_id[14].text == "Story 4 begins here, long enough.\n\nIt ends, 28.\n\nmore"
    assert by_id[30].text.count("word word") == 20_000
    assert html.extract_pages(table.where("false")).collect() == []


@pytest.mark.parametrize(
    "markup, text",
    [
        ('<article><p>a <span class="ad">Buy</span> b <span>c</span>d</p></article>', "a b cd"),
        ("<article><p>a</p><p>b</p><foot", "a\n\nb"), ("<article><p title='it's>a</p>", "a"), ('<article>1 < 2 & 3<p title="x>y">z</p></article>', "1 < 2 & 3\n\nz"),
        ("<body><header><p>top</p></header><main><p>m</p><nav>n</nav></main><p>rest</p>", "m"), ("<article><header><h1>t</h1></header><p>x</article>", "t\n\nx"),
        ("<div><p>only &lt;p&gt;</p><div hidden>h</div><div style='display: none'>n</div><div role=banner>b</div></div>", "only <p>"),
        ("<article><p>a</p><article class='comment'><p>c</p></article><!-- x --><script>if (a < b) {}</script></article>", "a"),
    ],
)
def test_extraction_of_single_pages(markup, text):
    assert html.extract_text(markup) == text


def test_wrappers_align_in_any_order():
    pages = [html.page_wrapper(html.parse(page(k, "<p>more</p>" * (k % 3) + "<table></table>" * (k % 2)))) for k in range(8)]

    def infer(order):
        out = pages[order[0]]
        for k in order[1:]:
            out = html.align(out, pages[k])
        return out

    shape = lambda nodes: [(n[0], n[1], n[2], shape(n[3]) if n[0] != "#" else n[3][:2]) for n in nodes]
    assert shape(infer(range(8))) == shape(infer(list(reversed(range(8)))))
    halves = html.align(infer(range(4)), infer(range(4, 8)))
    assert shape(halves) == shape(infer(range(8)))
    (body,) = [n for n in halves[0][3] if n[0] == "body"]
    div = next(n for n in body[3] if n[0] == "div.x")
    assert [(n[0], n[1], n[2]) for n in div[3]] == [("p", 2, 4), ("table", 0, 1)]


# URLs


def test_urls(spark):
    rows = [
        ("http://a.example.org/es/x", "example.org/es/", "block"), ("http://EXAMPLE.org/en/12", "example.org/en/1", "block"),
        ("https://x.org/en/2?q", "org/", "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://x.org", None, None),
        ("http://b.com/fr/", "com/fr/", "allow"), ("http://b.com/de/1#f", "com/de/", "block"), ("http://b.com/FR/", None, None),
        ("http://com/fr/", "com/fr/", "allow"), ("http://xcom/fr/", None, None), (None, None, None), ("no scheme", None, None), ("", None, None),
    ]
    many = [(f"http://h{k}.{'org' if k % 2 else 'com'}/{'en' if k % 2 else 'de'}/{k}", None, None) for k in range(40)]
    table = spark.createDataFrame([(k, u, "clash", "clash") for k, (u, _, _) in enumerate(rows + many)], "page_id long, url string, host string, label string")
    got = {r.page_id: r for r in urls.judge_urls(table).collect()}
    for k, (_, rule, verdict) in enumerate(rows):
        assert got[k].rule == rule
        assert got[k].verdict == verdict if rule else got[k].verdict in ("allow", "block")
        assert (got[k].score is None) == (rule is not None)
    assert (got[1].host, got[1].path) == ("example.org", "/en/12") and (got[2].host, got[2].path) == ("x.org", "/en/2")
    assert (got[10].host, got[10].path, got[11].host) == ("", "", "")
    none = urls.judge_urls(table.where("page_id = 7"))
    assert [(r.verdict, r.score) for r in none.collect()] == [("allow", None)]
    assert urls.judge_urls(table.where("false")).collect() == []


def judged_plainly(url, rules):
    """host, path and the fitting rule, by hand."""
    head, found, rest = (url or "").partition("://")
    if not found:
        host = path = ""
    else:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fitting = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fitting, default=(0, None, None))
    return host, path, rule, verdict


def test_hosts_paths_and_rules_against_brute_force(spark):
    rng = random.Random(9)
    parts = ["http://", "://", "/", "?", "#", "org", "example.org", ".", "com", "a", "A.", "en/1", "es/", "/fr/", "/de/", "É", "\n", ":", ""]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for k in range(600)] + [(600, None)]
    rows += [(700 + k, f"https://{h}{p}") for k, (h, p) in enumerate((h, p) for h in ("x.org", "www.example.org", "b.com") for p in ("/es/1", "/en/12", "/fr/", "/de/x", "", "?/es/"))]
    for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect():
        host, path, rule, verdict = judged_plainly(dict(rows)[r.page_id], urls.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_repeated_urls_do_not_fill_the_sample(spark):
    rows = [(k, "http://bad.example.net/same") for k in range(300)] + [(300 + k, f"http://{h}.example.net/{k}") for k, h in enumerate(["good", "bad"] * 10)]
    rows += [(900, "http://free.example.info/1")]
    table = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(table, [("block", "bad.example.net", "/"), ("allow", "good.example.net", "/")], train_rows=30).collect()
    assert len(got) == len(rows) and next(r.score for r in got if r.page_id == 900) is not None


def test_trees_learn_what_rules_label(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        bad = rng.random() < 0.5
        tail = "".join(rng.choice("0123456789") for _ in range(30)) if bad else "about-us"
        rows.append((k, f"http://{'bad' if bad else 'good'}.example.net/{tail}" if k % 2 else f"http://w{k}.example.info/{tail}", bad))
    table = spark.createDataFrame([(k, u) for k, u, _ in rows], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(table, [("block", "bad.example.net", "/"), ("allow", "good.example.net", "/")]).collect()}
    free = [(got[k].verdict == "block", bad) for k, _, bad in rows if got[k].rule is None]
    assert len(free) == 200 and sum(a == b for a, b in free) >= 190


# WARC


@pytest.mark.parametrize("least, known", [(0, 100_000), (5, 1), (0, 0)])
def test_warc_round_trip(spark, least, known, monkeypatch):
    monkeypatch.setattr(warc, "KNOWN_ROWS", known)
    big = "é<p>" * 400_000
    rows = [(1, "http://a/", "x\r\nWARC/1.1\r\n\r\n"), (2, "u\r\nX: y", None), (3, None, ""), (4, "u", big), (5, "u", "same text"), (9, "u", "same text"), (7, "u", "same text"), (8, "u", "ab"), (6, "u", "ab"), (4, "u", big), (None, "u", "ab")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    if known < 2:
        monkeypatch.setattr(warc, "BLOOM_BITS", 64)
    manifest = warc.write_archives(table, warc.archive_folder(spark), least)
    chunks = warc.read_chunks(manifest).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= least and i != first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "revisit" if again else "response", first[h or ""] if again else None))
    got = [tuple(r) for r in warc.archive_pages(table, least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and max(len(c.data) for c in chunks) <= warc.CHUNK
    # Page 4 is there twice, and so is each of its chunks.
    parts = sorted((c.chunk_no, bytes(c.data), c.payload_bytes, c.payload_digest) for c in chunks if c.page_id == "4" and c.record_type == "response")
    assert len(parts) == 2 * -(-len(big.encode()) // warc.CHUNK) and parts[::2] == parts[1::2]
    sha1, seen = hashlib.sha1(), 0
    for _, data, size, digest in parts[::2]:
        sha1.update(data)
        seen += len(data)
        assert (size, digest) == (seen, base64.b32encode(sha1.digest()).decode())
    assert warc.archive_pages(table.where("false")).collect() == []


def test_the_filter_of_digests_loses_none_and_passes_few(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOOM_BITS", 1 << 16)
    rows = spark.range(6000).select("id", F.sha1(F.col("id").cast("string")).alias("sha1"))
    known = rows.where("id < 2000").select(F.col("sha1").alias("q_sha1"))
    passed = {r.id for r in rows.where(warc._maybe_among(known, F.col("sha1"))).collect()}
    assert passed >= set(range(2000)) and len(passed) < 2080


def test_warc_ids_may_hold_anything(spark):
    ids = ["a\r\nX: y", "", None, "<p>", "é %41", "plain"]
    rows = [(i, "u", f"page {k}") for k, i in enumerate(ids)] + [("z\n", "u", "page 0")]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(got) == {*ids, "z\n"} and got["z\n"] == (6, "revisit", ids[0]) and got[""] == (6, "response", None)
