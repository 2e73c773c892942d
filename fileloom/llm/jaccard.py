"""N-gram Jaccard join: documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more, and the groups
that these links form. A size-aware heavy-light join, exact (no sketches decide):

1. Documents with equal sets become one representative (hash aggregation on the set's 128-bit sum).
2. Small sets, below a boundary chosen by cost, enumerate their subsets of the size that a similar set must share; equal
   subsets meet in a hash join. The boundary minimises keys written against lists scanned, from the counts of set sizes
   and the measured mean list length.
3. Large sets go into inverted lists on the shingles of a prefix, heavy shingles (long lists) last in the order. The
   smaller of two similar sets has a common shingle in its first (n - o + 1), so most shingles have no posting.
4. A list is not expanded into pairs. Lists without a member that may be the smaller of a similar pair are dropped. The
   others' members are first compared with one hub each; the links found are contracted to components; pairs with a
   member outside the hub's component are then formed of smaller and larger members alone, by ranges of sizes.
5. In a long list that has such members, the sets are put into lists anew, in the order of their shingles' frequencies
   among them, over all their shingles and not the low ones alone: what sets a member apart then comes first, and the
   positional bound leaves out pairs that have too much of it.
6. A pair must pass bounds on size, position and parity signature, and is then verified on the whole sets.

A shingle is a 64-bit hash of its words. Python (numpy, in Arrow batches) makes sets out of texts; all joining, counting
and contraction is done by DataFrame operations on slim rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, materialise

#: Frequencies are counted, and prefixes taken first, among the shingles whose hash is in this part of the hash space.
LOW = np.uint64(int(0.18 * 2**64))
#: Sets up to this size are kept whole beside their low shingles, so that their subsets can be enumerated.
SMALL_MOST = 40
#: In place of a position: the key is of a subset.
SUBSET = (1 << 31) - 1
#: A shingle in more sets than this is heavy. At most so many (1.6 MB) are known by name; the most frequent first.
HEAVY, HEAVY_MOST = 24, 200_000
#: Lists of more members are refined before members outside the hub's component are compared with them.
LONG = 64
#: Counted rows of a few numbers (members of components; texts that are verified) that may be broadcast, some 40 MB at
#: most; more are shuffled.
PICK_ROWS = 500_000
#: Members of a long list that one task compares with those outside.
PART = 2048

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


@dataclass(frozen=True)
class Similarity:
    """Sets of shingles of so many words are similar from this percentage of common shingles, in their union, on."""

    words: int = 3
    percent: int = 90

    def overlap(self, n: int, m: int) -> int:
        """The least common shingles of similar sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def probe_length(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def index_length(self, n: int) -> int:
        return n - self.overlap(n, n) + 1

    def partner_sizes(self, n: int) -> range:
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)


def shingle_set(text: str | None, ids: _WordIds, size: int = 3) -> np.ndarray:
    """The sorted distinct shingle hashes. bytes.lower() is A-Z alone, bytes.split() ASCII white space alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h + w[j : len(w) - k + 1 + j]) * _K[j % 3]
    return np.unique(_mix(h))


def _parity(s: np.ndarray) -> np.ndarray:
    """1024 bits; each shingle flips one, so two sets differ in at least as many shingles as bits."""
    bits = np.bincount((s & np.uint64(1023)).astype(np.int64), minlength=1024).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    ids = _WordIds()
    with np.errstate(over="ignore"):
        for batch in batches:
            n, sums, parity, low, ends = [], [[], []], [], [], [0]
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), ids, how.words)
                n.append(len(s))
                for j in (0, 1):
                    sums[j].append(int(_mix(s * _K[j] + _K[j + 1]).sum(dtype=np.uint64).view(np.int64)))
                parity.append(_parity(s))
                if len(s) > SMALL_MOST:
                    s = s[: max(int(np.searchsorted(s, LOW)), how.probe_length(len(s)))]
                low.append(s)
                ends.append(ends[-1] + len(s))
            flat = np.concatenate([*low, np.empty(0, np.uint64)]).view(np.int64)
            parity = np.concatenate([*parity, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "doc_id", "th")),
                    pa.array(n, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in sums),
                    pa.ListArray.from_arrays(pa.array(range(0, 16 * len(n) + 1, 16), pa.int32()), pa.array(parity)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["row", "doc_id", "th", "n", "h1", "h2", "bits", "low"],
            )


def _scan(docs: DataFrame, how: Similarity) -> DataFrame:
    """row, doc_id, th, n, h1, h2, bits, low. th: a hash of the text."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: _sets(batches, how),
        f"row long, doc_id {kind}, th long, n int, h1 long, h2 long, bits array<long>, low array<long>",
    )


def choose_boundary(sizes: dict[int, int], list_length: float, how: Similarity = Similarity()) -> int:
    """Sets below the result enumerate subsets. sizes: sets by size, up to SMALL_MOST."""
    best, best_cost, cost = 1, float("inf"), 0.0
    for n in range(1, SMALL_MOST + 1):
        rest = sum(c * how.probe_length(m) * (1 + list_length) for m, c in sizes.items() if m >= n)
        if cost + rest < best_cost:
            best, best_cost = n, cost + rest
        subsets = sum(comb(n, o) for m in how.partner_sizes(n) if (o := how.overlap(n, m)) <= n)
        cost += sizes.get(n, 0) * subsets
    return best


def _subset_keys(s: np.ndarray, below: int, how: Similarity) -> list[int]:
    """A key for each subset that a similar set of less than `below` shingles, of each size, must share."""
    from itertools import combinations

    n, keys = len(s), []
    mixed = [int(x) for x in _mix(s * _K[2] + _K[0])]
    total = sum(mixed)
    for m in how.partner_sizes(n):
        o = how.overlap(n, m)
        if m < below and o <= min(n, m):
            salt = (min(n, m) * 1_000_003 + max(n, m)) * 0x9E3779B97F4A7C15
            keys += [
                ((total - sum(gone) + salt) * 0xD6E8FEB86659FD93) % 2**64 for gone in combinations(mixed, n - o)
            ]
    return keys


POSTING = "key long, row long, meta long"


def _postings(heavy, below: int, how: Similarity, whole: bool = False):
    """POSTING rows for each set (row, n, low; whole: low is the whole set): meta is the set's size, the shingle's
    position in the set's order (all ones for a subset) and whether the set may be the smaller of a pair here, packed
    (32, 31 and 1 bits) to keep postings narrow."""
    most = -(-how.percent * below // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, metas, rows = [], [], []
                lows = batch.column("low")
                values, ends = lows.values.to_numpy().view(np.uint64), lows.offsets.to_numpy()
                for i, (row, n) in enumerate(zip(batch.column("row").to_numpy(), batch.column("n").to_numpy())):
                    s, n = values[ends[i] : ends[i + 1]], int(n)
                    if n < below:
                        found = np.array(_subset_keys(s, below, how), np.uint64)
                        keys.append(found)
                        metas.append(np.full(len(found), n << 32 | SUBSET << 1 | 1, np.int64))
                        rows.append(np.full(len(found), row, np.int64))
                    if n >= most:
                        at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                        is_heavy = (known[at] == s) if len(known) else np.zeros(len(s), bool)
                        p = how.probe_length(n)
                        pos = np.arange(p, dtype=np.int64)
                        keys.append(s[np.lexsort((s, is_heavy, s >= LOW) if not whole else (s, is_heavy))[:p]])
                        metas.append(n << 32 | pos << 1 | (pos < how.index_length(n)))
                        rows.append(np.full(p, row, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (rows, metas))],
                        names=["key", "row", "meta"],
                    )

    return run


def _unpacked(row: str, meta: str) -> Column:
    return F.expr(
        f"struct({row} as row, cast(shiftright({meta}, 32) as int) as n, "
        f"cast(shiftright({meta}, 1) & {SUBSET} as int) as pos, ({meta} & 1) = 1 as index)"
    )


def _may_link(a: str, b: str, how: Similarity) -> Column:
    """Bounds on two postings of one key: size, position, and that the smaller set has the index role."""
    need = f"ceil({how.percent} * ({a}.n + {b}.n) / {100 + how.percent}.0)"
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {how.percent} * greatest({a}.n, {b}.n) and "
        f"(({a}.index and {a}.n <= {b}.n) or ({b}.index and {b}.n <= {a}.n)) and "
        f"({a}.pos = {SUBSET}) = ({b}.pos = {SUBSET}) and "
        f"({a}.pos = {SUBSET} or least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need})"
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the structs x and y."""
    return pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def few(df: DataFrame) -> DataFrame:
    """A broadcast side only if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= PICK_ROWS else df


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, comp (the smallest node of its component) for every node of links(a, b) but those smallest ones.

    Alternating large and small stars, with minima taken by aggregation, so no node's neighbours are gathered. The minima,
    one row per node, are written down: they are broadcast if they are few, and if not, Spark can split the edges of a hot
    node in the join. Ends when all that is left are stars."""
    edges = links.where("a != b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    step = 0
    while True:
        # Large star: every neighbour above u goes to u's smallest neighbour, or u.
        both = edges.union(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = few(tables.save(least, f"{name}-{step}-large"))
        above = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("b"), F.col("b").alias("a"))
        # Small star: u and its smaller neighbours go to the smallest.
        least = tables.save(above.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), f"{name}-{step}-small")
        joined = above.join(few(least), F.col("a") == F.col("u"))
        rest = joined.where("b != m").select(F.col("m").alias("b"), F.col("b").alias("a"))
        edges = tables.save(rest.union(least.select(F.col("m").alias("b"), F.col("u").alias("a"))).distinct(), f"{name}-{step}")
        tables.remove(f"{name}-{step - 1}", f"{name}-{step}-large", f"{name}-{step}-small")
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        step += 1


def _heaviest(counts: DataFrame) -> np.ndarray:
    """The sorted shingles of counts(t, count) that are heavy: at most HEAVY_MOST numbers."""
    found = counts.where(F.col("count") > HEAVY).orderBy(F.desc("count"), "t").limit(HEAVY_MOST).select("t")
    return np.sort(found.toArrow()["t"].to_numpy().astype(np.int64).view(np.uint64))


class _Grouping:
    """The steps of group_documents, with what they share: the tables, the scanned rows, the links' components so far."""

    def __init__(self, docs: DataFrame, how: Similarity):
        self.docs, self.how, self.tables = docs, how, Tables(docs.sparkSession, "jaccard")
        self.comps: DataFrame | None = None
        self.broadcasts: list = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.tables.save(df, name)

    def share(self, numbers: np.ndarray):
        self.broadcasts.append(self.docs.sparkSession.sparkContext.broadcast(numbers))
        return self.broadcasts[-1]

    def members(self, postings: DataFrame, name: str) -> DataFrame:
        """key, row, meta, h_row, h_meta, many of the lists of two members or more, of which one may be the smaller of a
        pair: without one (a shingle that is common among sets that all begin with rarer ones) a list has no link. The hub:
        of those members, the one with the fewest shingles before this, then the first."""
        pos = f"least(shiftright(meta, 1) & {SUBSET}, 255L)"
        order = F.expr(f"shiftleft(1L - (meta & 1), 62) | shiftleft({pos}, 54) | row")
        lists = postings.groupBy("key").agg(
            F.count("*").alias("many"), F.min(order).alias("hub"), F.min_by("meta", order).alias("h_meta")
        )
        lists = lists.where("many > 1 and (h_meta & 1) = 1").select("key", F.expr(f"hub & {(1 << 54) - 1}").alias("h_row"), "h_meta", "many")
        # Written down, so that Spark can split the join of a hot list.
        lists = self.save(lists, f"{name}-lists")
        found = self.save(postings.join(lists, "key"), name)
        self.tables.remove(f"{name}-lists")
        return found

    def whole_sets(self, wanted: DataFrame) -> DataFrame:
        """row, s: the whole sets of wanted(row, doc_id, th), made again from their texts."""
        size = self.how.words
        wanted = few(wanted.select(F.col("row").alias("w_row"), F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")))
        own = F.col("doc_id").eqNullSafe(F.col("w_id"))
        texts = self.docs.select("doc_id", "text").join(wanted, (F.xxhash64("text") == F.col("w_th")) & own)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = _WordIds()
            with np.errstate(over="ignore"):
                for batch in batches:
                    found = [shingle_set(t.as_py(), ids, size).view(np.int64) for t in batch.column("text")]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("w_row"), pa.array(found, pa.list_(pa.int64()))], names=["row", "s"]
                    )

        # Rows that repeat both id and text are found more than once.
        return texts.select("w_row", "text").mapInArrow(whole, "row long, s array<long>").dropDuplicates(["row"])

    def verified(self, pairs: DataFrame, name: str) -> DataFrame | None:
        """The pairs (a, b) whose whole sets are similar; None if there are none."""
        slim, percent = self.sets.select("row", "n", "bits"), self.how.percent
        for side in ("a", "b"):
            pairs = pairs.join(slim.select([F.col(c).alias(f"{side}{'' if c == 'row' else '_' + c}") for c in slim.columns]), side)
        far = F.expr("aggregate(zip_with(a_bits, b_bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
        differ = F.col("a_n") + F.col("b_n") - 2 * F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100.0 + percent))
        pairs = self.save(pairs.where(far <= differ).select("a", "b", "a_n", "b_n"), f"{name}-pairs")
        if pairs.isEmpty():
            return None
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        wanted = self.save(wanted.join(self.sets.select("row", "doc_id", "th"), "row"), f"{name}-wanted")
        whole = self.save(self.whole_sets(wanted), f"{name}-sets")
        for side in ("a", "b"):
            pairs = pairs.join(whole.select(F.col("row").alias(side), F.col("s").alias(f"{side}_s")), side)
        common = F.size(F.array_intersect("a_s", "b_s"))
        linked = 100 * common >= percent * (F.col("a_n") + F.col("b_n") - common)
        links = self.save(pairs.where(linked).select("a", "b"), f"{name}-links")
        self.tables.remove(f"{name}-pairs", f"{name}-wanted", f"{name}-sets")
        return links

    def merge(self, links: DataFrame | None, name: str) -> bool:
        """Takes links into the components: only links between different components so far are left to be followed.
        Whether any was."""
        if links is None:
            return False
        if self.comps is None:
            self.comps = components(links, self.tables, f"{name}-stars")
            return True
        known = few(self.comps.select(F.col("node").alias("k_node"), F.col("comp").alias("k_comp")))
        for side in ("a", "b"):
            links = links.join(known, F.col(side) == F.col("k_node"), "left").withColumn(side, F.coalesce("k_comp", side)).select("a", "b")
        links = self.save(links.where("a != b").distinct(), f"{name}-new")
        if links.isEmpty():
            return False
        more = components(links, self.tables, f"{name}-stars")
        further = more.select(F.col("node").alias("k_node"), F.col("comp").alias("k_comp"))
        moved = self.comps.join(few(further), F.col("comp") == F.col("k_node"), "left")
        moved = moved.select("node", F.coalesce("k_comp", "comp").alias("comp")).union(more)
        self.comps = self.save(moved, f"{name}-components")
        return True

    def outside(self, members: DataFrame, name: str) -> DataFrame:
        """Members with c and h_c, their own and their hub's component, and whether these differ."""
        if self.comps is None:
            found = members.withColumns({"c": F.col("row"), "h_c": F.col("h_row")})
        else:
            found, own = members, few(self.comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp")))
            for row, c in (("row", "c"), ("h_row", "h_c")):
                found = found.join(own, F.col(row) == F.col("_node"), "left")
                found = found.withColumn(c, F.coalesce("_comp", row)).drop("_node", "_comp")
        return self.save(found.withColumn("out", F.col("c") != F.col("h_c")), name)

    def star_pairs(self, members: DataFrame) -> DataFrame:
        """Each member with its list's hub."""
        x, y = _unpacked("row", "meta").alias("x"), _unpacked("h_row", "h_meta").alias("y")
        return _ordered(members.where("row != h_row").select(x, y).where(_may_link("x", "y", self.how)))

    def rest_pairs(self, split: DataFrame) -> DataFrame:
        """Pairs of a list's members in different components, one of them outside the hub's. The smaller one of a similar
        pair has the index role, so members with it (those outside, and those inside, which are to meet those outside
        alone) are joined to members of at least their size, by ranges of sizes so wide that a partner's is the own or the
        next. A long list is dealt out in parts of some PART members, and each smaller member meets all of them."""
        parts = F.ceil(F.col("many") / PART).cast("int")
        # A trifle wider than the largest ratio of sizes, so that rounding can't put a partner beyond the next range.
        size = F.floor(F.log(F.shiftright("meta", 32).cast("double")) / float(np.log(100 / self.how.percent) * (1 + 1e-9)))
        listed = split.where("row != h_row").withColumn("range", size.cast("int"))
        listed = listed.join(split.where("out").select("key").distinct(), "key", "left_semi")
        places = F.explode(F.sequence(F.lit(0), 2 * parts - 1))
        smaller = listed.where("(meta & 1) = 1").select("*", places.alias("place"))
        smaller = smaller.select(
            "key", F.expr("range + place % 2").alias("range"), F.expr("cast(place div 2 as int)").alias("part"), "out",
            F.col("c").alias("x_c"), _unpacked("row", "meta").alias("x"),
        )
        part = F.pmod(F.xxhash64("row"), parts).cast("int").alias("part")
        larger = listed.select("key", "range", part, "out", F.col("c").alias("y_c"), _unpacked("row", "meta").alias("y"))
        pairs = [smaller.where(own).drop("out").join(larger.where(other).drop("out"), ["key", "range", "part"]) for own, other in (("out", "true"), ("not out", "out"))]
        return _ordered(pairs[0].union(pairs[1]).where("x_c != y_c and x.n <= y.n").where(_may_link("x", "y", self.how)))

    def run(self) -> tuple[DataFrame, DataFrame | None]:
        how, tables = self.how, self.tables
        rows = self.save(_scan(self.docs, how), "scanned")
        # A set is known by its size and 128 bits. Empty sets are alone.
        by_set = self.save(rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("row").alias("group")), "groups")
        self.sets = self.save(rows.join(by_set.select(F.col("group").alias("row")), "row", "left_semi"), "representatives")

        tokens = self.sets.select(F.explode("low").alias("t")).where(F.expr(f"t >= 0 and t < {int(LOW)}"))
        counts = self.save(tokens.groupBy("t").count().where("count > 1"), "frequent")
        stats = counts.agg(F.sum(F.col("count") * F.col("count")).alias("sq"), F.sum("count").alias("s")).first()
        sizes = {r.n: r["count"] for r in self.sets.where(F.col("n") <= SMALL_MOST).groupBy("n").count().collect()}
        below = choose_boundary(sizes, (stats.sq or 0) / max(stats.s or 0, 1), how)

        shared = self.share(_heaviest(counts))
        postings = self.save(self.sets.select("row", "n", "low").mapInArrow(_postings(shared, below, how), POSTING), "postings")
        members = self.members(postings, "members")
        tables.remove("postings", "frequent")
        tables.free_shuffles()
        self.merge(self.verified(self.star_pairs(members), "hub"), "hub")
        split = self.outside(members, "outside")
        tables.remove("members")
        tables.free_shuffles()
        self.merge(self.verified(self.rest_pairs(split.where(f"many <= {LONG}")), "rest"), "rest")

        far = split.where(f"many > {LONG}")
        far = far.join(far.where("out").select("key").distinct(), "key", "left_semi").select("row").distinct()
        far = self.save(self.sets.select("row", "doc_id", "th", "n").join(far, "row", "left_semi"), "far")
        tables.remove("outside")
        tables.free_shuffles()
        if not far.isEmpty():
            self.refine(far)

        keys = by_set.select(*[F.col(c).alias(f"g_{c}") for c in ("n", "h1", "h2")], "group")
        same = (F.col("n") == F.col("g_n")) & (F.col("h1") == F.col("g_h1")) & (F.col("h2") == F.col("g_h2"))
        rows = rows.select("row", "doc_id", "th", "n", "h1", "h2").join(keys, same, "left")
        rows = rows.select("row", "doc_id", "th", "n", F.coalesce("group", "row").alias("group"))
        return rows, self.comps

    def refine(self, far: DataFrame) -> None:
        """The links within long lists: their sets far(row, doc_id, th, n) in lists anew, by all their shingles."""
        whole = self.whole_sets(far).join(far.select("row", "n"), "row").withColumnRenamed("s", "low")
        whole = self.save(whole, "far-sets")
        counts = whole.select(F.explode("low").alias("t")).groupBy("t").count().where(F.col("count") > HEAVY)
        postings = whole.select("row", "n", "low").mapInArrow(_postings(self.share(_heaviest(counts)), 1, self.how, True), POSTING)
        members = self.members(self.save(postings, "far-postings"), "far-members")
        self.tables.remove("far-sets", "far-postings")
        split = self.outside(members, "far-outside")
        if self.merge(self.verified(self.star_pairs(split.where("out")), "far-hub"), "far-hub"):
            split = self.outside(members, "far-outside-2")
        self.merge(self.verified(self.rest_pairs(split), "far-rest"), "far-rest")


def _labelled(docs: DataFrame, how: Similarity) -> DataFrame:
    """row, doc_id, th, n, c for every row of docs: c, the row that names the component."""
    work = _Grouping(docs, how)
    rows, comps = work.run()
    if comps is not None:
        rows = rows.join(few(comps), F.col("group") == F.col("node"), "left").withColumn("group", F.coalesce("comp", "group"))
    found = work.save(rows.select("row", "doc_id", "th", "n", F.col("group").alias("c")), "labelled")
    work.tables.remove("scanned", "groups", "representatives", "far")
    for shared in work.broadcasts:
        shared.destroy()
    return found


def join_similar(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text).

    component_id: the smallest doc_id that links reach, its own included; nulls do not count (a group of null ids alone
    has null). Null, empty and wordless texts: n_shingles 0, linked with nothing. Texts of fewer words than a shingle:
    one shingle. Rows with one id and different texts are documents of their own; repeated rows give repeated rows.
    Other columns are not read. Empty table: empty result.
    """
    rows = _labelled(docs, how)
    # Only components of several rows have another's id. Written down, so that Spark can split the join of a large one.
    least = rows.groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1")
    least = materialise(least.select(F.col("c").alias("l_c"), "least"), "least")
    rows = rows.join(few(least), F.col("c") == F.col("l_c"), "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of docs, with all their columns, of which each group of similar documents keeps one: that with the
    smallest doc_id (null last), of equal ids the one with the smaller text hash, of equal rows one. Null, empty and
    wordless texts are alone and stay. Empty table: empty result."""
    rows = _labelled(docs, how)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = rows.groupBy("c").agg(F.min(name).alias("first"), F.count("*").alias("many")).where("many > 1")
    first = materialise(first.select(F.col("c").alias("f_c"), "first"), "first")
    gone = rows.join(few(first), F.col("c") == F.col("f_c")).where(~name.eqNullSafe(F.col("first")))
    # Rows that go, by id and text: few beside those that stay.
    gone = materialise(gone.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).distinct(), "gone")
    on = F.col("_row.doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("_row.text") == F.col("g_th"))
    out = docs.select(F.struct("*").alias("_row")).join(few(gone), on, "left_anti")
    # Equal rows are rare: only their texts are shuffled.
    again = rows.where("n > 0").groupBy("doc_id", "th").count().where("count > 1")
    if again.isEmpty():
        return out.select("_row.*")
    again = materialise(again.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")), "again")
    on = F.col("_row.doc_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("_row.text") == F.col("r_th"))
    once = out.join(few(again), on, "left_semi").withColumn("_th", F.xxhash64("_row.text"))
    once = once.groupBy(F.col("_row.doc_id"), "_th").agg(F.first("_row").alias("_row")).select("_row")
    return out.join(few(again), on, "left_anti").union(once).select("_row.*")
