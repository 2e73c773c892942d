"""Quality rules: a table of thresholds compiled into one projection, built-in functions only.

Every measure is taken from the whole text inside the row: no shuffle, no Python, and work in proportion to the text
(n log n for the sort of a document's own windows), so one very long document costs no more than as many short ones.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, whole_row

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this
to was we were which with you
au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour qu que qui sa se ses
son sur un une vous
als am auch auf aus bei bin bis das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach
nicht noch nur oder sich sie sind so und vom von war wie wird zu zum zur über
al como con del el en era es esta este la las lo los más me no o para pero por que se si sin su sus un una y ya
""".split()

#: (measure, least, most); None: no bound. Kept if every measure that can be taken lies within.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_ratio", None, 0.25),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.5),
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _counts(rows: DataFrame) -> DataFrame:
    """Adds the counts to rows with a non-null `_text`.

    Windows found twice: the hash of each 3-word window is packed with its position into one bigint and sorted as
    primitives; neighbours with equal hash bits are candidates, and only these are compared by their words, so the
    count is exact whatever the hash does.
    """
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rows = rows.withColumn("_words", F.expr(rf"regexp_extract_all(_text, r'{WORD}', 0)"))
    rows = rows.withColumns(
        {
            "n_words": F.expr("cast(size(_words) as bigint)"),
            "_bits": F.expr("length(bin(size(_words)))"),
            "_lines": F.expr(rf"filter(split(_text, '\n'), l -> l rlike r'{WORD}')"),
        }
    )
    rows = rows.withColumns(
        {
            "_keys": F.expr(
                "sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> "
                "shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits) | cast(i as bigint)))"
            ),
            "word_chars": F.expr(rf"cast(length(regexp_replace(_text, r'{SPACE}', '')) as bigint)"),
            "n_symbols": F.expr(r"cast(length(regexp_replace(_text, r'[^#*$%&|<>]+', '')) as bigint)"),
            "n_lines": F.expr("cast(size(_lines) as bigint)"),
            "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"),
            "n_stop_words": F.expr(f"cast(size(filter(_words, w -> lower(w) in ({stop}))) as bigint)"),
        }
    )
    rows = rows.withColumn(
        "_twice",
        F.expr(
            "sort_array(transform(filter(_keys, (k, j) -> "
            "shiftright(k, _bits) = shiftright(get(_keys, j - 1), _bits) or "
            "shiftright(k, _bits) = shiftright(get(_keys, j + 1), _bits)), "
            "k -> cast(k & (shiftleft(1L, _bits) - 1) as int)))"
        ),
    )
    rows = rows.withColumn(
        "_twice",
        F.expr(
            "sort_array(transform(_twice, p -> struct("
            "concat_ws(' ', get(_words, p), get(_words, p + 1), get(_words, p + 2)) as g, p as p)))"
        ),
    )
    return rows.withColumn(
        "n_repeat_words",
        F.expr(
            "cast(size(array_distinct(flatten(transform(filter(_twice, (x, j) -> "
            "x.g = get(_twice, j - 1).g or x.g = get(_twice, j + 1).g), "
            "x -> array(x.p, x.p + 1, x.p + 2))))) as bigint)"
        ),
    ).drop("_words", "_bits", "_lines", "_keys", "_twice")


def _verdict(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    measure = {
        "mean_word_chars": F.col("word_chars") / F.col("n_words"),
        "symbol_ratio": F.col("n_symbols") / F.col("n_words"),
        "stop_word_ratio": F.col("n_stop_words") / F.col("n_words"),
        "dup_line_ratio": F.col("n_dup_lines") / F.col("n_lines"),
    }
    bounds = [measure[m] >= low for m, low, _ in thresholds if low is not None]
    bounds += [measure[m] <= high for m, _, high in thresholds if high is not None]
    return reduce(and_, bounds, F.lit(True))


def judge(rows: DataFrame, thresholds=None) -> DataFrame:
    """Adds counts, `base_failed` and `kept` to rows with a non-null `_text`."""
    rows = _counts(rows).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    # n_words is at least 50 wherever the quotients are used
    verdict = _verdict(THRESHOLDS if thresholds is None else thresholds)
    return rows.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict))


def measure_rules(docs: DataFrame, thresholds=None) -> DataFrame:
    """One row per row of docs(doc_id, text): the counts, base_failed, kept.

    A null or empty text has no words: all counts 0, base_failed true. Repeated rows give repeated rows. Other columns
    of docs are not read. An empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return judge(rows, thresholds).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words",
    )


def keep_by_rules(docs: DataFrame, thresholds=None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names, in one pass over the text.
    Null, empty and wordless texts go; repeated rows stay or go together; an empty table stays empty.

    The row's number is part of the condition because a condition on deterministic columns alone would be moved below
    the projections of the counts, and each count written out in it again and again."""
    rows = judge(whole_row(docs), thresholds).withColumn("_at", F.monotonically_increasing_id())
    return rows.where("kept and _at >= 0").select("_row.*")
