from fileloom.llm import license_texts, licenses


def test_titled_and_reserved_texts(spark):
    body = license_texts._BSD_HEAD + license_texts._BSD_3 + license_texts._BSD_TAIL
    mine = "Copyright (c) 2010, Some People\n"
    texts = ["BSD 3-Clause License\n\n" + mine + body, mine + "All rights reserved.\n" + body,
             "BSD 3-Clause License\n\n" + mine + "All rights reserved.\n" + body, mine + body,
             body + "All rights reserved.\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan_licenses(docs).collect()}
    noted = "all-rights-reserved"
    bsd = "BSD-3-Clause"
    assert got == {0: (bsd, ""), 1: (bsd, noted), 2: (bsd, noted), 3: (bsd, ""), 4: (None, noted)}


def test_digests_of_long_texts(spark, tmp_path):
    """Where the system has the texts: their digests, and a folder of texts as the known table."""
    import os

    import pytest

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    texts = {n: open(f"{folder}/{f}", encoding="utf-8").read() for f, n in names.items() if os.path.isfile(f"{folder}/{f}")}
    rows = [(n, t.upper().replace(" ", "\n ")) for n, t in texts.items() if "opyright" not in t] + list(texts.items())
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string"))
    assert all(r.license == r.doc_id for r in got.where("doc_id in ('Apache-2.0', 'MPL-2.0', 'GPL-3.0', 'LGPL-2.1')").collect())
    for n, t in texts.items():
        assert license_texts.DIGESTS[licenses.text_digest(t)] == n
        (tmp_path / f"own-{n}.txt").write_text(t)
    known = licenses.licenses_in(spark, f"file://{tmp_path}")
    got = licenses.scan_licenses(spark.createDataFrame([(1, next(iter(texts.values()))), (2, "x")], "doc_id long, text string"), known)
    assert {r.doc_id: r.license for r in got.collect()} == {1: f"own-{next(iter(texts))}", 2: None}


def test_known_tables_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(licenses, "KNOWN_ROWS", 0)
    mit = next(t for t, n in license_texts.LICENSES.items() if n == "MIT")
    rows = [(1, mit), (2, "text\nAll rights reserved."), (3, None)]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "all-rights-reserved"), 3: (None, "")}


def test_spellings_of_several_words_and_wrapped_notices(spark):
    """Variants of known texts as they are found; and texts that only look alike."""
    mit = next(t for t, n in license_texts.LICENSES.items() if n == "MIT" and "sublicense" in t)
    bsd = license_texts._BSD_HEAD + license_texts._BSD_3 + license_texts._BSD_TAIL
    wrapped = "Copyright (c) 2001-2020, The Very Long Name of a Foundation\n                         and of its many contributors\n    in all their places\n"
    texts = {
        1: (mit.replace("sublicense", "sub-license"), "MIT"), 2: (mit.replace("sublicense", "sub license"), "MIT"), 3: (mit.replace("copyright holder", "copyright owner").replace("COPYRIGHT HOLDER", "Copyright\nOwner"), "MIT"),
        4: (wrapped + bsd, "BSD-3-Clause"), 5: (" * " + wrapped.replace("\n  ", "\n\t\t\t\t") + bsd, "BSD-3-Clause"), 6: (wrapped.replace("\n  ", "\n\n  ") + bsd, None),
        7: (wrapped.replace("Copyright (c)", "Copyrighted by") + bsd, None), 8: (mit.replace("sublicense", "relicense"), None),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()} == {k: n for k, (_, n) in texts.items()}
