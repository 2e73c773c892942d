"""Cross-tokenizer alignment: where two tokenizers of a text cut it at the same byte, which of their tokens overlap, and how
often the corpus links each pair of tokens.

1. mapInPandas encodes each text by both tokenizers and merges the cumulative byte ends of their tokens, both sorted, with
   a pointer into either: each end that comes next closes one link, between the tokens that the pointers are at, and an
   end that both have closes a group. Emitted are a document's groups and its links, equal pairs of ids counted.
2. Spark groups all links by pair and sums the counts, takes the maxima of each id of either side, and joins counts and
   maxima back to the documents' links, which are summed up by document.

Documents' links are written down as arrays of pair codes, so texts are encoded once. The vocabularies are files whose
paths are parameters; each Python worker reads them once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .tokens import PATTERN

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Pieces of texts whose tokens a worker remembers, and the characters of those that it doesn't.
CACHE, LONG = 300_000, 40
#: Texts are aligned so many bytes at a time; a longer one is alone.
BATCH_BYTES = 1 << 20
#: Counted pairs that are broadcast (some 60 MB); more are joined by a shuffle.
PAIR_ROWS = 1_000_000
#: Bits of a pair's code that hold the id of the second side.
SIDE_BITS = 15
SPACE = "▁"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as their characters and the others as those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Side:
    """A tokenizer: the ids of texts (None for one that its tokens' bytes don't give back), and its tokens' lengths."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.digits = [np.array([f"{k}{end}" for k in range(len(tokens))], "S7") for end in ",|;"]

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        raise NotImplementedError


class ByteSide(Side):
    """A byte-level vocabulary whose merges are ranked by their results' ids, on texts with a space before them."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        of, vocabulary = _byte_of(), model["vocab"]
        ranks = {bytes(map(of.__getitem__, token)): i for token, i in vocabulary.items() if set(token) <= of.keys()}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        super().__init__(tokens)
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or model.get("ignore_merges"):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        specials = {t for t in vocabulary if re.fullmatch(r"<\|.*\|>", t)}
        self.model = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in specials}, special_tokens={}
        )

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        found = []
        for text in texts:
            ids = self.model.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
            # Tokens are cut out of the text's bytes: if none is missing, they are all of it.
            whole = int(self.lengths[ids].sum()) == len(text.encode("utf-8", "surrogatepass")) + 1
            found.append(ids if whole else None)
        return found


class PieceSide(Side):
    """A vocabulary of pieces; the tokenizer adds the space itself. Where no piece holds a space after another character,
    merges don't cross a space after one: the text is encoded from run of spaces to run of spaces, and these are
    remembered, as the bytes of their ids, or None if their tokens don't give them back."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        byte = self.model.is_byte
        super().__init__([bytes([int(p[3:5], 16)]) if byte(i) else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(pieces)])
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and SPACE in pieces
        self.split = re.compile(r" +[^ ]*" if apart else r"(?s).+").findall
        self.alone = [pieces.index(SPACE)] if SPACE in pieces else []
        self.known: dict[str, bytes | None] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        split = [self.split(" " + text) for text in texts]
        missing = list({piece for pieces in split for piece in pieces if piece not in self.known})
        # The space that begins a run is the one that the tokenizer adds; it adds none to an empty text.
        for piece, ids in zip(missing, self.model.encode([p[1:] for p in missing], num_threads=1), strict=True):
            ids = ids if len(piece) > 1 else self.alone
            whole = b"".join(map(self.tokens.__getitem__, ids)) == piece.encode("utf-8", "surrogatepass")
            self.known[piece] = np.array(ids, "<u2").tobytes() if whole else None
        found: list[np.ndarray | None] = []
        for pieces in split:
            try:
                found.append(np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u2").astype(np.int64))
            except TypeError:
                found.append(None)
        if len(self.known) > CACHE:
            self.known.clear()
        for piece in missing:
            if len(piece) > LONG:
                self.known.pop(piece, None)
        return found


@cache
def byte_side(path: str = BYTE_VOCABULARY) -> ByteSide:
    return ByteSide(path)


@cache
def piece_side(path: str = PIECE_VOCABULARY) -> PieceSide:
    return PieceSide(path)


def merge_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The links of two rows of tokens of the same bytes, given by their cumulative ends (each ascending, the last ones
    equal): where each link ends, the places of its tokens, and whether either of them ends there. The two rows are merged
    into one; each end in it closes a link, and moves the pointers of the sides that it is an end of."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")  # two ascending runs: a merge
    ends, of_a = both[order], order < len(a)
    first = np.concatenate([[True], ends[1:] != ends[:-1]])
    at = np.flatnonzero(first)
    up_a, up_b = np.cumsum(of_a), np.cumsum(~of_a)
    x, y = up_a[at] - of_a[at], up_b[at] - ~of_a[at]
    twice = np.concatenate([~first[1:], [False]])[at]
    return ends[at], x, y, of_a[at], ~of_a[at] | twice


def _groups(ids: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, sides: tuple[Side, Side]) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` for all groups, as texts of fixed width padded with zero bytes, and the place of each group's end."""
    closes = ends_a & ends_b
    group = np.cumsum(closes) - closes
    last_a, last_b = x[closes], y[closes]
    out = np.empty(len(ids[0]) + len(ids[1]), "S7")
    # A token comes after the first side's tokens up to its group's end, and the second side's of the groups before.
    before = np.concatenate([[0], last_b + 1])
    at_a = np.arange(len(ids[0])) + before[group[ends_a]]
    at_b = np.arange(len(ids[1])) + (last_a + 1)[group[ends_b]]
    for at, own, last, side, end in ((at_a, ids[0], last_a, sides[0], 1), (at_b, ids[1], last_b, sides[1], 2)):
        out[at] = side.digits[0][own]
        out[at[last]] = side.digits[end][own[last]]
    return out, last_a + last_b + 2


def align_texts(texts: list[str | None], sides: tuple[Side, Side]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts of each text; pairs: codes of linked ids, ascending."""
    found: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
    some = [k for k, text in enumerate(texts) if text]
    encoded = zip(some, *(side.encode([texts[k] for k in some]) for side in sides), strict=True)
    rows = [(k, a, b) for k, a, b in encoded if a is not None and b is not None]
    if not rows:
        return found
    ids = np.concatenate([a for _, a, _ in rows]), np.concatenate([b for _, _, b in rows])
    # One merge for all: texts end where both sides do.
    ends, x, y, ends_a, ends_b = merge_ends(*(np.cumsum(side.lengths[own]) for side, own in zip(sides, ids, strict=True)))
    codes = ids[0][x] << SIDE_BITS | ids[1][y]
    digits, group_ends = _groups(ids, x, y, ends_a, ends_b, sides)
    # The link with which each text's tokens end, and the groups up to it.
    last = np.cumsum([len(a) for _, a, _ in rows]) - 1
    upto = np.searchsorted(x, last, "right")
    groups = np.cumsum(ends_a & ends_b)[upto - 1]
    link_at = group_at = 0
    for (k, a, b), links, until in zip(rows, upto.tolist(), groups.tolist(), strict=True):
        text = digits[group_ends[group_at - 1] if group_at else 0 : group_ends[until - 1]].tobytes().translate(None, b"\0")
        own = np.sort(codes[link_at:links])
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.append(starts, len(own)))
        digest = hashlib.sha256(text[:-1]).hexdigest()
        found[k] = (len(a), len(b), until - group_at, links - link_at, digest, own[starts].astype(np.int32), counts.astype(np.int32))
        link_at, group_at = links, until
    return found


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]


def align(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts of each row of docs(doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = byte_side(byte_vocabulary), piece_side(piece_vocabulary)
        for frame in frames:
            start = size = 0
            for k, text in enumerate(frame["text"], 1):
                size += len(text or "")
                if size >= BATCH_BYTES or k == len(frame):
                    part = frame.iloc[start:k]
                    out = pd.DataFrame(align_texts(list(part["text"]), sides), columns=_NAMES)
                    out.insert(0, "doc_id", part["doc_id"].to_numpy())
                    yield out
                    start, size = k, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, counts array<int>"
    # Pandas would make floating-point numbers of ids beside a null.
    rows = docs.select(*[F.col(c).cast("string").alias(c) for c in ("doc_id", "text")])
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def align_tokenizers(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a for each row of docs(doc_id, text).

    n_best: links whose pair's count is the highest of its second side's id, ties included; n_best_a: of its first side's.
    Null and empty texts, and those that a tokenizer doesn't give back whole, have no tokens: zeros and ''. Repeated rows
    count each time. Other columns are not read. Empty table: empty result."""
    tables = Tables(docs.sparkSession, "alignment")
    rows = tables.save(align(docs, byte_vocabulary, piece_vocabulary).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("l"))
    links = links.select("row", F.col("l.pairs").alias("pair"), F.col("l.counts").alias("n"))
    pairs = tables.save(links.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    sides = {"a": F.shiftright("pair", SIDE_BITS), "b": F.col("pair").bitwiseAND((1 << SIDE_BITS) - 1)}
    known = pairs.withColumns(sides)
    for side in sides:
        most = pairs.groupBy(sides[side].alias(side)).agg(F.max("count").alias(f"most_{side}"))
        known = known.join(most, side)
    best = [(F.col("count") == F.col(f"most_{side}")).alias(f"best_{side}") for side in sides]
    known = tables.save(known.select(F.col("pair").alias("k_pair"), "count", *best), "known")
    known = F.broadcast(known) if known.count() <= PAIR_ROWS else known
    of = lambda best: F.sum(F.when(F.col(best), F.col("n")).otherwise(0))
    sums = links.join(known, F.col("pair") == F.col("k_pair")).groupBy(F.col("row").alias("s_row"))
    sums = sums.agg(of("best_b").alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"), of("best_a").alias("n_best_a"))
    sums = tables.save(sums, "sums")
    found = rows.join(sums, F.col("row") == F.col("s_row"), "left")
    some = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum", "n_best_a")]
    tables.remove("pairs", "known")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *some[:2], "groups_sha256", some[2])
