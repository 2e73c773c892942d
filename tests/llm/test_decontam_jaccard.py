import hashlib
import random
import re

import pytest

from fileloom.llm import decontam, jaccard

DOCS = "doc_id long, text string, row string"
ITEMS = "item_id long, text string"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contaminated(text, items):
    ws, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            for at in range(len(ws) - n + 1):
                if ws[at : at + n] == w[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(i)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    return len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_contamination_against_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(spark.conf, "set", spark.conf.set)
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "É", "x1", *[f"w{k}" for k in range(12)]]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = [make(40) for _ in range(4)]
    items = [(k, t) for k, t in enumerate(long)]
    items += [(10, "rare Pair"), (11, "single"), (12, None), (13, ""), (14, "!! --"), (2, long[3]), (15, make(13)), (16, long[0])]
    docs = [(k, make(rng.randrange(0, 80)), "c") for k in range(15)]
    docs += [
        (20, make(30) + "\n" + long[1].upper().replace("É", "É") + make(5), "c"), (21, " ".join(long[0].split()[3:16]), "c"),
        (22, "a single word", "c"), (23, "rare, pair; rare pair", "c"), (24, None, "c"), (25, "", "c"), (None, long[2], "c"),
        (26, long[0] * 3, "c"), (26, long[0] * 3, "c"), (27, make(3000) + " single", "c"), (28, "single", "c"),
    ]
    got = decontam.find_contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *contaminated(t, items)) for i, t, _ in docs), key=key)


def test_empty_tables_and_stage(spark):
    docs = spark.createDataFrame([(1, "one two three", "c"), (1, "clean words only", "c"), (None, "one two three", "c"), (2, None, "c")], DOCS)
    items = spark.createDataFrame([(1, "one two three")], ITEMS)
    assert {(r.doc_id, r.text) for r in decontam.drop_contaminated(docs, items).collect()} == {(1, "clean words only"), (2, None)}
    assert decontam.drop_contaminated(docs, items).columns == docs.columns
    none = items.where("false")
    assert [r.n_hit for r in decontam.find_contamination(docs, none).collect()] == [0] * 4
    assert decontam.find_contamination(docs.where("false"), items).collect() == []


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def groups(docs, size=3, percent=90):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [shingles(t, size) for _, t, _ in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least.get(top(i))) for i, ((d, _, _), s) in enumerate(zip(docs, sets))]


def near_copies(seed):
    """Texts of all lengths; copies with a few words changed, up to and beyond the threshold; a large group of copies of
    one base with more or fewer edits; a passage that many unlike texts share."""
    rng = random.Random(seed)
    make = lambda n: [f"v{rng.randrange(400)}" if rng.random() < 0.8 else "the" for _ in range(n)]
    out = []
    passage = make(60)
    for n in [1, 2, 3, 4, 7, 11, 12, 13, 14, 20, 21, 22, 23, 29, 33, 41, 60, 90, 150, 300, 700]:
        base = make(n)
        out.append(base)
        for edits in (0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1])
                copy = copy or ["e"]
            out.append(copy)
        out += [base[:-1] or ["z"], base[: max(1, int(n * 0.93))]]
    base = make(150)
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(150)] = f"u{rng.randrange(10**6)}"
        out.append(copy)
    out += [passage + make(rng.randrange(2, 60)) for _ in range(40)]
    docs = [(k, " ".join(w), "c") for k, w in enumerate(out)]
    rng.shuffle(docs)
    return docs + [(900, None, "c"), (901, "", "c"), (902, " \n", "c"), (None, docs[0][1], "c"), (None, "alone", "c"), docs[3], docs[3], (docs[4][0], "other text", "c")]


@pytest.mark.parametrize("seed, heavy, long, part", [(1, 24, 64, 2048), (2, 3, 6, 4)])
def test_groups_against_all_pairs(spark, seed, heavy, long, part, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "PART", part)
    if part < 100:
        monkeypatch.setattr(jaccard, "PICK_ROWS", 0)
    docs = near_copies(seed)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    got = [tuple(r) for r in jaccard.join_similar(frame).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(groups(docs), key=key)


def test_other_shingles_and_percentages(spark):
    docs = near_copies(6)
    got = [tuple(r) for r in jaccard.join_similar(spark.createDataFrame(docs, DOCS), jaccard.Similarity(5, 80)).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(groups(docs, 5, 80), key=key)


@pytest.mark.parametrize("boundary", [1, 15, 24])
def test_any_boundary_gives_the_same(spark, boundary, monkeypatch):
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *args: boundary)
    docs = [d for d in near_copies(4) if d[1] is None or len(d[1].split()) < 45]
    got = [tuple(r) for r in jaccard.join_similar(spark.createDataFrame(docs, DOCS)).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(groups(docs), key=key)


def test_one_of_a_group_stays(spark):
    docs = [(5, "a b c d e f", "c"), (3, "A b c d e f", "c"), (3, "A b c d e f", "c"), (9, "q r s", "c"), (None, "q r s", "c"), (7, None, "c"), (8, None, "c"), (None, "n", "c")]
    out = jaccard.keep_one(spark.createDataFrame(docs, DOCS))
    assert out.columns == ["doc_id", "text", "row"]
    key = lambda r: str(r)
    want = [(3, "A b c d e f", "c"), (9, "q r s", "c"), (7, None, "c"), (8, None, "c"), (None, "n", "c")]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], DOCS)
    assert jaccard.keep_one(none).collect() == [] and jaccard.join_similar(none).collect() == []


def test_boundary_by_cost():
    assert jaccard.choose_boundary({}, 5) == 1
    assert jaccard.choose_boundary({8: 1000}, 30.0) == 9
    assert 10 < jaccard.choose_boundary({n: 100 for n in range(1, 41)}, 20.0) < 30


def rest_candidates(spark, docs, monkeypatch):
    """Rows of the joins that rest_pairs makes, before and after their bounds."""
    found, own = [], jaccard._Grouping.rest_pairs

    def counted(self, split):
        pairs = own(self, split)
        found.append(pairs.count())
        return pairs

    with monkeypatch.context() as m:
        m.setattr(jaccard._Grouping, "rest_pairs", counted)
        got = jaccard.join_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)
    return sum(found)


def test_documents_of_a_template_that_never_link_make_no_pairs(spark, monkeypatch):
    """Texts of which 92 % is the same and the rest is their own: shared shingles are in every set, and no pair is similar."""
    rng = random.Random(2)
    template = [f"t{rng.randrange(5000)}" for _ in range(276)]
    docs = [(k, " ".join(template + [f"own{k}x{j}" for j in range(24 + k % 5)])) for k in range(260)]
    few = rest_candidates(spark, docs[:90], monkeypatch)
    assert few <= 90 and rest_candidates(spark, docs, monkeypatch) <= 3 * few + 260


def test_sizes_at_the_edges_of_ranges(spark):
    """Sets and their largest similar supersets, in lists that only some members are linked in."""
    rng = random.Random(4)
    docs = []
    for n in [45, 63, 90, 99, 180, 450, 900]:
        base = [f"b{n}x{j}" for j in range(n + 2)]
        for copy in range(6):
            docs.append((len(docs), " ".join(base + [f"e{n}x{copy}x{j}" for j in range(n // 9)]), "c"))
            docs.append((len(docs), " ".join(base[: len(base) - copy % 3] + [rng.choice("pq")] * (copy % 2)), "c"))
        docs.append((len(docs), " ".join(base + [f"far{n}x{j}" for j in range(n // 9 + 1)]), "c"))
    got = [tuple(r) for r in jaccard.join_similar(spark.createDataFrame(docs, DOCS)).collect()]
    assert sorted(got) == sorted(groups(docs))
