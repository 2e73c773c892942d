"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, built-in functions only.

A window (13 consecutive item words; a shorter item is one window) is the set of its 3-word shingles, and must be
contained whole. So of its shingles, ordered by rarity in the documents, one is a long enough prefix: the rarest.

1. One pass over the texts finds the places of benchmark shingles (a hash join on the shingle): three numbers each. This
   gives the shingles' frequencies over all documents. A window with a shingle that no document has can't occur.
2. Each window that is left is joined with the places of its rarest shingle alone; a place must leave room for the window
   before and after it (positional and length bounds).
3. The documents that have such places, which are few, are read again, and their words there compared with the windows.

A side of a join is broadcast only while the count of its own rows is below BROADCAST_ROWS; beyond, the same join
shuffles, and only numbers. A shingle's hash only proposes places: the result depends on words alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, ascii_lower, materialise

#: Fixed value: after lower-casing, words are runs of a-z, 0-9 and all characters beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: Rows of a few numbers, or of a window's words, that may be broadcast: some 16 MB, and 100 MB at most.
BROADCAST_ROWS = 500_000
#: A document is contaminated if at least one in so many of its words is hit.
MIN_SHARE = 20


def words_of(text: Column) -> Column:
    """Null has no words."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def _shingles(words: str, k: int) -> str:
    """SQL: the hash of the k words from each position on."""
    parts = ", ".join(["w", *(f"get({words}, i + {j})" for j in range(1, k))])
    return f"transform(slice({words}, 1, greatest(size({words}) - {k - 1}, 0)), (w, i) -> xxhash64({k}, {parts}))"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, win (its words): one row per distinct window of an item."""
    rows = items.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    every = F.expr(
        f"array_distinct(transform(sequence(0, greatest(size(words) - {window}, 0)), i -> slice(words, i + 1, {window})))"
    )
    return rows.select("item", F.explode(every).alias("win")).distinct()


def _window_shingles(wins: DataFrame) -> DataFrame:
    """win_id, len, k, n_sh, off, sh of wins(win_id, win): a row for each shingle of k words."""
    wins = wins.withColumn("k", F.least(F.size("win"), F.lit(SHINGLE)))
    by_k = F.expr("CASE k " + " ".join(f"WHEN {k} THEN {_shingles('win', k)}" for k in range(1, SHINGLE + 1)) + " END")
    wins = wins.withColumn("shs", by_k)
    return wins.select("win_id", F.size("win").alias("len"), "k", F.size("shs").alias("n_sh"), F.posexplode("shs").alias("off", "sh"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast side only if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _places(docs: DataFrame, known: DataFrame, n_known: int, ks: list[int]) -> DataFrame:
    """row, pos, sh, n_words for each place of a known shingle of one of the lengths ks, and for each row of docs one with
    pos -1, doc_id and th, a hash of its text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("_w"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # One bigint per place, a null last: the document's own row, which needs no match.
    every = F.concat(*[F.expr(_shingles("_w", k)) for k in ks], F.array(F.lit(None).cast("bigint")))
    rows = rows.select("row", "doc_id", "th", F.size("_w").alias("n_words"), every.alias("shs"))
    rows = rows.select("row", "doc_id", "th", "n_words", F.posexplode("shs").alias("at", "sh"))
    base, pos = "0", "CASE"
    for k in ks:
        after = f"{base} + greatest(n_words - {k - 1}, 0)"
        base, pos = after, f"{pos} WHEN at < {after} THEN at - ({base})"
    rows = rows.withColumn("pos", F.expr(f"{pos} ELSE -1 END") if ks else F.lit(-1))
    own = lambda c: F.when(F.col("pos") == -1, F.col(c)).alias(c)
    rows = rows.select("row", "pos", "sh", "n_words", own("doc_id"), own("th"))
    key = F.coalesce(F.col("sh"), F.xxhash64("row"))  # so that the rows without a shingle spread
    found = rows.join(_small(known.select(F.col("sh").alias("b_sh")), n_known), key == F.col("b_sh"), "left")
    return found.where("pos = -1 or b_sh is not null").drop("b_sh")


def _prefixes(shingles: DataFrame, hits: DataFrame) -> DataFrame:
    """sh, off, len: of each window whose shingles all occur, the one that is rarest in the documents, and where it is."""
    counts = hits.groupBy("sh").agg(F.count("*").alias("n"))
    of_window = Window.partitionBy("win_id")  # at most as many rows as a window has words
    ranked = shingles.join(counts, "sh").withColumns(
        {"rank": F.row_number().over(of_window.orderBy("n", "sh", "off")), "have": F.count("*").over(of_window)}
    )
    return ranked.where("rank = 1 and have = n_sh").select("sh", "off", "len").distinct()


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, occurrences, windows): doc_id, th, n_words for every row of docs; doc_id, th, start, len, win_id for
    every place at which a window occurs; win_id, item for every item's windows. th: a hash of the text."""
    tables = Tables(docs.sparkSession, "decontaminate")
    of_items = tables.save(item_windows(items, window), "item-windows")
    wins = tables.save(of_items.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id()), "windows")
    shingles = tables.save(_window_shingles(wins), "shingles")
    known = tables.save(shingles.select("sh").distinct(), "known")
    ks = sorted(r.k for r in shingles.select("k").distinct().collect())  # at most SHINGLE numbers
    places = tables.save(_places(docs, known, known.count(), ks), "places")
    rows = places.where("pos = -1").select("row", "doc_id", "th", "n_words")
    hits = places.where("pos >= 0").select("row", "pos", "sh", "n_words")

    prefixes = tables.save(_prefixes(shingles, hits), "prefixes")
    n_wins = prefixes.count()
    prefixes = prefixes.select(F.col("sh").alias("p_sh"), "off", "len")
    start = F.col("pos") - F.col("off")
    found = hits.join(_small(prefixes, n_wins), F.col("sh") == F.col("p_sh")).select("row", start.alias("start"), "len", "n_words")
    found = found.where("start >= 0 and start + len <= n_words").select("row", "start", "len").distinct()
    # At most one of a length for each word of a document.
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    found = found.join(rows, "row").groupBy("doc_id", "th").agg(F.first("spans").alias("spans"))
    found = tables.save(found.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "spans"), "candidates")

    n_found = found.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.xxhash64("text") == F.col("c_th"))
    texts = docs.select("doc_id", "text").join(_small(found, n_found), same)
    texts = texts.select("c_id", "c_th", "spans", words_of(F.col("text")).alias("words"))
    cut = F.expr("transform(spans, s -> struct(s.start as start, s.len as len, slice(words, s.start + 1, s.len) as words))")
    cut = texts.select("c_id", "c_th", F.explode(cut).alias("s")).select("c_id", "c_th", "s.*")
    equal = (F.xxhash64("words") == F.xxhash64("win")) & (F.col("words") == F.col("win"))
    occurrences = cut.join(_small(wins, wins.count()), equal)
    occurrences = occurrences.select(F.col("c_id").alias("doc_id"), F.col("c_th").alias("th"), "start", "len", "win_id").distinct()
    occurrences = tables.save(occurrences, "occurrences")
    tables.remove("shingles", "known", "prefixes", "candidates")
    return rows.drop("row"), occurrences, of_items.join(_small(wins, wins.count()), "win").select("win_id", "item")


def _hits(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): find_windows' documents, and h_id, h_th, hit, n_items, ids for those with an occurrence."""
    rows, occurrences, windows = find_windows(docs, items, window)
    spans = occurrences.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    words = "size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.len - 1)))))"
    spans = spans.select("doc_id", "th", F.expr(words).alias("hit"))
    of_docs = occurrences.select("doc_id", "th", "win_id").distinct().join(windows, "win_id")
    of_docs = of_docs.groupBy("doc_id", "th").agg(F.collect_set(F.struct(F.col("item").cast("string").alias("id"))).alias("items"))
    of_docs = of_docs.select(
        F.col("doc_id").alias("h_id"),
        F.col("th").alias("h_th"),
        F.size("items").alias("n_items"),
        F.expr("array_join(array_sort(filter(transform(items, x -> x.id), x -> x is not null)), ',')").alias("ids"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th"))
    return rows, materialise(of_docs.join(spans, same).select("h_id", "h_th", "hit", "n_items", "ids"), "hits")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs(doc_id, text).

    Whole texts of both tables. A word inside any occurrence of a window is hit, once. items_sha256 is of the empty
    string if no item occurs. Null or empty text: no words, not contaminated. Null item texts have no windows; equal
    items each count; rows that repeat an item_id count as one item with all their windows, a null item_id is left out
    of the digest but counts as an item. Repeated documents give repeated rows. Empty tables: no rows, or no hits.
    """
    rows, hits = _hits(docs, items, window)
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th"))
    out = rows.join(_small(hits, hits.count()), same, "left")
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.col("ids"), F.lit("")), 256).alias("items_sha256"),
        _contaminated(n_hit).alias("contaminated"),
    )


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (MIN_SHARE * n_hit >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    A row is known by its id and its text's hash, so null and repeated ids are judged by their own text. Null, empty and
    wordless texts stay; repeated rows stay or go together; empty tables: nothing goes. Only the ids that go are joined
    with the texts, and only beyond BROADCAST_ROWS of them are texts shuffled."""
    rows, hits = _hits(docs, items, window)
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th"))
    bad = rows.join(_small(hits, hits.count()), same).where(_contaminated(F.col("hit"))).select("h_id", "h_th").distinct()
    bad = materialise(bad, "contaminated")
    same = F.col("_row.doc_id").eqNullSafe(F.col("h_id")) & (F.xxhash64("_row.text") == F.col("h_th"))
    return docs.select(F.struct("*").alias("_row")).join(_small(bad, bad.count()), same, "left_anti").select("_row.*")
