import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from math import comb

import numpy as np
import pytest
import sentencepiece
import tokenizers
import xxhash

from fileloom.llm import alignment, audit, jaccard, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, row string, print string"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


# Cross-tokenizer alignment


def plain_tokens():
    """Each side's ids and bytes of a text, by whole texts."""
    a = tokenizers.Tokenizer.from_file(alignment.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_VOCABULARY)
    to_byte = alignment._byte_of()

    def first(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in ids]

    def second(text):
        out = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
        return out

    return first, second


def plain_alignment(texts):
    """Everything that the operator returns of each text, by spans of bytes and all pairs of tokens."""
    first, second = plain_tokens()
    rows, total = [], Counter()
    for text in texts:
        sides = (first(text), second(text)) if text else ([], [])
        if text and any(b"".join(x for _, x in side) != b" " + text.encode() for side in sides):
            sides = ([], [])
        spans = []
        for side in sides:
            at, own = 0, []
            for i, data in side:
                own.append((i, at, at + len(data)))
                at += len(data)
            spans.append(own)
        links = Counter((i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e)
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, at = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for i, s, e in side if at <= s and e <= end) for side in spans))
            at = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(spans[0]), len(spans[1]), len(groups), digest, links))
        total += links
    best = [Counter(), Counter()]
    for pair, n in total.items():
        for side in (0, 1):
            best[side][pair[side]] = max(best[side][pair[side]], n)
    of = lambda links, side: sum(n for p, n in links.items() if total[p] == best[side][p[side]])
    return [
        (a, b, g, sum(x.values()), of(x, 1), sum(n * total[p] for p, n in x.items()), d, of(x, 0)) for a, b, g, d, x in rows
    ]


def odd_texts():
    rng = random.Random(3)
    parts = ["the ", "  ", "\n", "\t", "don't ", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x0A>", "naïve ", "日本語", "😀", " ", "x" * 60, "12345 ", "été ", "é", "ﬁ", "ＡＢ", "--- ", "\r\n", "\x00", "​", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    return [*texts, None, "", " ", "  ", "   x", "a", "▁", "a▁b", "word " * 3000, "a b ", "a b  ", "\n"]


def test_alignment_against_all_pairs_of_tokens(spark):
    texts = odd_texts()
    texts += texts[:7]
    rows = [(k if k != 9 else None, t, "x", "r", "p") for k, t in enumerate(texts)] + [(1, texts[1], "x", "r", "p"), (2**62 + 1, "one more", "x", "r", "p")]
    got = alignment.align_tokenizers(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = Counter((r[0], *w) for r, w in zip(rows, plain_alignment([r[1] for r in rows]), strict=True))
    assert Counter(map(tuple, got)) == want
    assert sum(w[1] > 0 for w in want) > 50 and any(w[1] == 0 for w in want)


def test_alignment_of_shuffled_counts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIR_ROWS", 0)
    monkeypatch.setattr(alignment, "CACHE", 3)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 40)
    texts = odd_texts()[:20] + ["tie tie", "other words"]
    got = alignment.align_tokenizers(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(plain_alignment(texts))
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_pieces_of_texts_give_the_tokens_of_whole_texts(spark):
    whole_a, whole_b = plain_tokens()
    a, b = alignment.byte_side(), alignment.piece_side()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for text in [r.text for r in rows] + odd_texts():
        if text:
            own = [side.encode([text])[0] for side in (a, b)]
            for ids, whole in zip(own, (whole_a(text), whole_b(text)), strict=True):
                given_back = b"".join(data for _, data in whole) == b" " + text.encode()
                assert ids.tolist() == [i for i, _ in whole] if given_back else ids is None


# SimHash


def plain_print(text):
    words = WORDS.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42) for s in shingles]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def plain_components(prints, ids):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least.get(top(i)) for i in range(len(prints))]


def test_fingerprints_and_components_against_all_pairs(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ß", "日本"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(5):
            own = list(words)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\t", "\n "]).join(own))
    texts += [None, "", " \n", "one", "ONE", "two words", "a b c", texts[0].upper(), "x " * 70_000, "A b c d"]
    ids = [*range(100, 100 + len(texts))]
    ids[3], ids[-1] = None, 100
    rows = [(i, t, "x", "r", "p") for i, t in zip(ids, texts, strict=True)] + [(100, texts[0], "x", "r", "p")]
    got = simhash.link_prints(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    prints = [plain_print(t) for _, t, *_ in rows]
    want = zip([r[0] for r in rows], prints, plain_components(prints, [r[0] for r in rows]), strict=True)
    assert Counter(map(tuple, got)) == Counter((i, f"{p:016x}", c) for i, p, c in want)


@pytest.mark.parametrize("tile,block,stripe,broadcast", [(2048, 256, 16, True), (7, 3, 1, True), (5, 2, 2, False)])
def test_tiles_lose_no_link(spark, tile, block, stripe, broadcast, monkeypatch):
    """Chains of fingerprints 3 bits apart, a large group around one, and many others; links across all tiles."""
    for name, value in (("TILE", tile), ("BLOCK", block), ("STRIPE", stripe)):
        monkeypatch.setattr(simhash, name, value)
    if not broadcast:
        monkeypatch.setattr(jaccard, "PICK_ROWS", 0)
    rng = random.Random(tile)
    flip = lambda p, n: p ^ sum(1 << k for k in rng.sample(range(64), n))
    prints = [0, 2**64 - 1, *(rng.getrandbits(64) for _ in range(100))]
    for _ in range(3):
        prints.append(rng.getrandbits(64))
        for _ in range(12):
            prints.append(flip(prints[-1], 3))
    hub = rng.getrandbits(64)
    prints += [hub, *(flip(hub, rng.randrange(1, 4)) for _ in range(60)), *(flip(p, 4) for p in prints[:20])]
    rng.shuffle(prints)
    given = spark.createDataFrame([(k, int(np.uint64(p).astype(np.int64))) for k, p in enumerate(prints)], "doc_id long, print long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "print"))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.link_prints(given.repartition(4)).collect()}
    want = plain_components(prints, list(range(len(prints))))
    assert got == {k: (p, c) for k, (p, c) in enumerate(zip(prints, want, strict=True))}


def test_a_group_gives_a_forest_and_not_all_pairs(spark):
    hub = 0x0123456789ABCDEF
    prints = np.array([hub ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)] + [hub], np.uint64)
    tops, forest = simhash._within(prints)
    assert len(forest) == len(prints) - 1 and set(tops.tolist()) == {0} and len(prints) == comb(64, 2) + 1


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id string, text string, lang string")
    assert simhash.link_prints(none).collect() == []
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    assert audit.audit_filters(none, labels).collect() == []


# Filter interaction audit


def plain_audit(docs, labels):
    quality, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    texts = [t or "" for _, t, *_ in docs]
    failing = []
    for (i, *_), t in zip(docs, texts, strict=True):
        words = WORDS.findall(t)
        failing.append(
            {
                "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": i is not None and any(j is not None and j < i and u == t for (j, *_), u in zip(docs, texts, strict=True)),
            }
        )
    out = []
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, failing, strict=True) if (d[2] or "") == part]
        rows, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                alone = sum(x[f] and sum(x.values()) == 1 for _, x in own)
                lost = [sum(i in marked for i, _ in gone) for marked in (quality, toxic)]
                rows.append((part, "".join(order), step, len(left), len(gone), sum(x[f] for _, x in own) - len(gone), alone, *lost))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_audit_against_every_order(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(jaccard, "PICK_ROWS", 0)
    rng = random.Random(8)
    docs = []
    for k in range(60):
        n = rng.choice([3, 150, 199, 200, 260])
        vocabulary = [f"w{j}" for j in range(rng.choice([20, 100, 400]))] + rng.choice([[], ["ABC"], ["Äé"], ["a#b"], ["50%", "|"]])
        docs.append((k if k != 7 else None, rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(n)), rng.choice(["en", "de", None, ""]), "r", "p"))
    docs += [(100 + k, docs[k % 9][1], "fr", "r", "p") for k in range(15)] + [docs[3], docs[3], (200, None, "en", "r", "p"), (201, "", "de", "r", "p"), (202, None, "nl", "r", "p"), (7, "Of   " * 40_000, "it", "r", "p")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 210, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    got = audit.audit_filters(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert got.count() == 600 * len({d[2] or "" for d in docs})


def test_every_set_of_filters_is_applied_once(spark, tmp_path):
    tables = audit.Tables(spark, "trie")
    docs = spark.createDataFrame([("en", i >> 0 & 1 == 1, i >> 1 & 1 == 1, i >> 2 & 1 == 1, i >> 3 & 1 == 1, i >> 4 & 1 == 1, False, False) for i in range(32)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    trie = audit.Trie(docs, tables)
    assert sorted(trie.counted) == list(range(32))
    rows = {r.node: r for r in trie.rows().collect()}
    assert all(r.kept == 2 ** (5 - node.bit_count()) for node, r in rows.items())
    assert rows[0b00011].removed_A is None and rows[0b00011].removed_C == 4
