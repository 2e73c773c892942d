"""Token counts that follow edits: a document's pre-tokens are the leaves' contents of a segment tree that sums characters
and tokens. An edit re-encodes the leaves that it touches, some pre-tokens before them, and what follows only until the
new pre-tokens end where an old leaf ended; then the sums above the changed leaves are updated.

Trees are a stored table (token_trees: the text and its leaves' sums). Edits are applied to the stored trees, those of a
column of theirs (count_edited) or of a table that is joined by document (apply_edits). The vocabulary is a file whose
path is a parameter; the driver reads it once and broadcasts it (under 1 MB).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables

#: Fixed value: how this vocabulary's texts are split into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf when a tree is built; a leaf of over 4 times as many is split.
LEAF = 64
#: A pre-token's end depends on few characters after it: so many pre-tokens and characters are encoded again before an
#: edit, and so many characters (or all to the text's end) are looked at after the leaves that are encoded again.
CONTEXT_PIECES, CONTEXT_CHARS = 4, 16
CACHE = 400_000
EDIT_TYPE = "array<struct<start:int,end:int,replacement:string>>"


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[piece] = found = len(self.encoding.encode_ordinary(piece))
        return found

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        found = self.split(text)
        return found, list(map(self.__getitem__, found))


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Tree:
    """Leaves hold texts of whole pre-tokens; sums is a heap of (characters, tokens, pre-tokens): node i has 2i and 2i+1."""

    def __init__(self, counter: Counter, leaves: list[str], counts: list[tuple[int, int]]):
        """counts: tokens and pre-tokens of each leaf."""
        self.counter, self.leaves = counter, leaves
        self.width = 1 << max(len(leaves) - 1, 0).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        for i, (leaf, (tokens, pieces)) in enumerate(zip(leaves, counts, strict=True)):
            self.sums[self.width + i] = len(leaf), tokens, pieces
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def build(cls, counter: Counter, text: str) -> Tree:
        pieces, counts = counter.pieces(text)
        return cls(counter, *_leaves(pieces, counts, LEAF))

    n_tokens = property(lambda self: int(self.sums[1, 1]))
    n_pieces = property(lambda self: int(self.sums[1, 2]))
    n_chars = property(lambda self: int(self.sums[1, 0]))
    text = property(lambda self: "".join(self.leaves))

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at this place (the last leaf for the text's end), and where the leaf begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at - begin >= self.sums[node, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        leaf = node - self.width
        if leaf >= len(self.leaves):
            leaf = max(len(self.leaves) - 1, 0)
            begin = self.n_chars - int(self.sums[self.width + leaf, 0])
        return leaf, begin

    def _set(self, leaf: int, text: str, tokens: int, pieces: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        self.sums[node] = len(text), tokens, pieces
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replaces text[start:end]; places beyond the text are its end. Returns how many pre-tokens were encoded."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if not self.leaves:
            self.leaves = [""]
        first, begin = self.find(start)
        pieces, chars = 0, start - begin  # whole pre-tokens before the edit, and characters, from `begin` on
        while first and (pieces < CONTEXT_PIECES or chars < CONTEXT_CHARS):
            first -= 1
            begin -= len(self.leaves[first])
            pieces += int(self.sums[self.width + first, 2])
            chars = start - begin
        last, last_begin = self.find(end)
        stop = last + 1
        old = "".join(self.leaves[first:stop])
        new = old[: start - begin] + replacement + old[end - begin :]
        encoded = 0
        while True:
            # The text that follows shows where the pre-tokens end; those that end with the old leaf are right.
            ahead, seen = "", stop
            while len(ahead) < CONTEXT_CHARS and seen < len(self.leaves):
                ahead += self.leaves[seen]
                seen += 1
            found = self.counter.split(new + ahead)
            at = kept = 0
            for kept, piece in enumerate(found):  # noqa: B007
                if at >= len(new):
                    break
                at += len(piece)
            else:
                kept = len(found)
            if at == len(new):
                found = found[:kept]
                break
            new += self.leaves[stop]
            stop += 1
        counts = list(map(self.counter.__getitem__, found))
        encoded += len(found)
        n = stop - first
        size = max(-(-len(found) // n), 1)
        leaves, sums = _leaves(found, counts, size)
        if size > 4 * LEAF:
            whole = [(int(t), int(p)) for _, t, p in self.sums[self.width : self.width + len(self.leaves)]]
            leaves, sums = _leaves(found, counts, LEAF)
            self.__init__(
                self.counter, self.leaves[:first] + leaves + self.leaves[stop:], whole[:first] + sums + whole[stop:]
            )
        else:
            for i in range(n):
                self._set(first + i, *((leaves[i], *sums[i]) if i < len(leaves) else ("", 0, 0)))
        return encoded


def _leaves(pieces: list[str], counts: list[int], size: int) -> tuple[list[str], list[tuple[int, int]]]:
    at = range(0, len(pieces), size)
    return ["".join(pieces[i : i + size]) for i in at], [
        (sum(counts[i : i + size]), min(size, len(pieces) - i)) for i in at
    ]


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


TREE = "text string, n_tokens long, n_pieces long, leaf_chars array<long>, leaf_tokens array<long>, leaf_pieces array<long>"
_LEAVES = ("leaf_chars", "leaf_tokens", "leaf_pieces")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.empty(0, np.int64)]), pa.int64()))


def _columns(trees: list[Tree], texts: pa.Array) -> list[pa.Array]:
    """The columns of TREE."""
    leaves = [t.sums[t.width : t.width + len(t.leaves)] for t in trees]
    totals = [pa.array([int(t.sums[1, j]) for t in trees], pa.int64()) for j in (1, 2)]
    return [texts, *totals, *(_lists([x[:, j] for x in leaves]) for j in range(3))]


def _stored(batch: pa.RecordBatch, counter: Counter) -> Iterator[Tree]:
    """The trees of a batch with the columns of TREE, without encoding anything."""
    lists = [batch.column(c) for c in _LEAVES]
    ends, values = lists[0].offsets.to_numpy(), [x.values.to_numpy() for x in lists]
    for i, text in enumerate(batch.column("text")):
        text, leaves, at = text.as_py() or "", [], 0
        chars, tokens, pieces = (v[ends[i] : ends[i + 1]].tolist() for v in values)
        for n in chars:
            leaves.append(text[at : at + n])
            at += n
        yield Tree(counter, leaves, list(zip(tokens, pieces, strict=True)))


def _apply(tree: Tree, edits: list[dict] | None) -> int:
    return sum(tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "") for e in edits or ())


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the columns of TREE for each row of docs(doc_id, text): its tree, whose leaves are the text's next
    leaf_chars characters each. Null and empty texts: no leaves, no tokens. Repeated rows give repeated rows; other
    columns are not read. Empty table: empty result."""
    ranks = _shared(docs.sparkSession, vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            trees = [Tree.build(counter, t.as_py() or "") for t in batch.column("text")]
            columns = _columns(trees, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], names=["doc_id", "text", "n_tokens", "n_pieces", *_LEAVES]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {TREE}")


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, the columns of TREE and encoded for the trees (of token_trees) that have edits: the trees after them.

    edits(doc_id, seq, start, end, replacement) apply in the order of seq, each to the text that the ones before it have
    made; null replacements are empty, null places 0, places beyond the text its end. encoded: pre-tokens encoded again.
    doc_id is unique in trees; null ids and ids without a tree have no edits. A document's edits meet in one row, as its
    text does; documents without edits are not sent to Python. Empty tables: empty result."""
    ranks = _shared(trees.sparkSession, vocabulary)
    grouped = edits.groupBy("doc_id").agg(
        F.expr(
            "transform(array_sort(collect_list(struct(seq, start as s, end as e, replacement as r))), "
            "x -> struct(cast(x.s as int) as start, cast(x.e as int) as end, x.r as replacement))"
        ).alias("edits")
    )
    rows = trees.join(grouped, "doc_id").select("doc_id", "text", "n_tokens", "n_pieces", *_LEAVES, "edits")
    kind = trees.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            found = list(_stored(batch, counter))
            encoded = [_apply(tree, e.as_py()) for tree, e in zip(found, batch.column("edits"), strict=True)]
            columns = _columns(found, pa.array([t.text for t in found], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(encoded, pa.int64())],
                names=["doc_id", "text", "n_tokens", "n_pieces", *_LEAVES, "encoded"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, {TREE}, encoded long")


def count_edited(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pieces, edited_chars, edited_tokens, encoded for each row of trees (of token_trees) with a
    column edits (EDIT_TYPE, in order; null: none): counts before and after the row's own edits.

    Texts without tokens have 0. Edits may empty a text, or overlap what earlier ones wrote; places beyond the text are
    its end. Repeated rows and null ids give a row each. Other columns are not read. Empty table: empty result.
    """
    ranks = _shared(trees.sparkSession, vocabulary)
    kind = trees.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            rows = []
            for tree, edits in zip(_stored(batch, counter), batch.column("edits"), strict=True):
                encoded = _apply(tree, edits.as_py())
                rows.append((tree.n_chars, tree.n_tokens, encoded))
            columns = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_tokens", "n_pieces")), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_tokens", "n_pieces", "edited_chars", "edited_tokens", "encoded"],
            )

    rows = trees.select("doc_id", "text", "n_tokens", "n_pieces", *_LEAVES, F.col("edits").cast(EDIT_TYPE).alias("edits"))
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, n_pieces long, edited_chars long, edited_tokens long, encoded long",
    )


def count_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """count_edited for docs(doc_id, text): stores their trees, draws edits for each row of the stored table, and applies
    them there."""
    trees = Tables(docs.sparkSession, "token-trees").save(token_trees(docs, vocabulary), "trees")
    return count_edited(derived_edits(trees), vocabulary)


def derived_edits(docs: DataFrame, edits: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) with edits drawn from hashes of the id: each replaces up to 39 characters anywhere in the
    text by up to 59 others of it. A null text has edits with null replacements."""
    draw = lambda j: f"pmod(xxhash64(doc_id, i, {j}), %s)"
    return docs.withColumn(
        "edits",
        F.expr(
            f"transform(transform(sequence(1, {int(edits)}), i -> struct({draw(1) % '(length(text) + 1)'} as s, "
            f"{draw(2) % '40'} as n, {draw(3) % '(length(text) + 1)'} as f, {draw(4) % '60'} as m)), "
            "x -> struct(cast(x.s as int) as start, cast(x.s + x.n as int) as end, "
            "substring(text, cast(x.f as int) + 1, cast(x.m as int)) as replacement))"
        ),
    )
