"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Each document draws an exponential key, -ln(u) / weight, with u from a hash of its id and text, so reruns agree. Within its
source documents are taken in the order of their keys until the source's token budget is met. The order is never
gathered in one task: keys fall into a fixed number of ranges by a monotone map (the distribution of keys that the
source's own weights give, so that ranges are even), the ranges' sums are prefix-summed (one row per source and range),
and only the rows of one range of one source meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialise

#: Sources in the order of their names' code points, null last, weigh 3, 1, 2, and so on again.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: Ranges of keys within a source. A source with a third of 10^10 documents has some 10^6 of them in each.
RANGES = 2048
#: Weights of a source are known by classes, each narrower than one part in so many of its weight.
WEIGHT_CLASSES = 32
#: Sources whose weights may be broadcast (some 1.2 KB each); more are joined by a shuffle, each in SALTS parts.
SOURCE_ROWS, SALTS = 10_000, 64
SEED = 20240131
LEAST_WEIGHT = 1e-3


def quality_weight(text: Column) -> Column:
    """0.1 to 1: documents with many symbols are drawn later. Taken over the whole text; null or empty: 1."""
    share = F.length(F.regexp_replace(text, r"[^#*$%&|<>!]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), 1.0 - 4.0 * F.coalesce(share, F.lit(0.0)))


def _uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """In (0, 1): 52 bits of a hash that any engine has, moved off 0."""
    known = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(known), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _source_targets(slim: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target: one row per source. Water filling without a loop: with the sources in the order of
    cap / weight, the level that serves all but the first k is (budget - caps of the k) / (weights of the rest); the
    first k whose level is not above its next source's cap / weight is right. A source without words gets 0."""
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    caps = sums.withColumn("w", F.element_at(pattern, (rank % len(weights) + 1).cast("int"))).withColumn(
        "cap", max_epochs * F.col("source_size")
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = caps.withColumns(
        {
            "budget": F.least(share * F.sum("source_size").over(every), F.sum("cap").over(every)),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "rest": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    ).withColumn("level", (F.col("budget") - F.col("capped")) / F.col("rest"))
    found = levels.withColumn(
        "level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("capped", "level"))).over(every)
    )
    filled = F.coalesce(F.col("level.level") * F.col("w"), F.col("cap"))
    return found.select("source", "source_size", F.least(F.col("cap"), filled).alias("target"))


def _in_ranges(slim: DataFrame, ranges: int) -> DataFrame:
    """slim with range: keys in their order, about as many of a source in each. A key of weight w is above x with
    probability exp(-w x), so the source's keys up to x are the mean of 1 - exp(-w x) over its weights. Any monotone map
    gives right results; the classes are written down, so that all readers of the ranges have the same map."""
    in_class = F.floor(F.log("weight") * WEIGHT_CLASSES)
    classes = slim.groupBy("source", in_class.alias("class")).agg(F.count("*").alias("n"), F.avg("weight").alias("w"))
    known = classes.groupBy(F.col("source").alias("w_source")).agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("w", "n"))).alias("classes")
    )
    known = known.select("w_source", F.expr("transform(classes, c -> struct(c.w as w, c.n / total as share))").alias("classes"))
    known = materialise(known, "mix-weights")
    same = F.col("source").eqNullSafe(F.col("w_source"))
    if known.count() <= SOURCE_ROWS:
        rows = slim.join(F.broadcast(known), same)
    else:
        parts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = slim.join(parts, same & (F.pmod(F.xxhash64("key"), F.lit(SALTS)) == F.col("salt"))).drop("salt")
    up_to = F.expr("aggregate(classes, 0.0D, (s, c) -> s + c.share * (1.0D - exp(-c.w * key)))")
    return rows.withColumn("range", (up_to * ranges).cast("int")).drop("w_source", "classes")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    ranges: int = RANGES,
    seed: int = SEED,
    weight: Column | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, weight for each row of docs(doc_id, text, source).

    size: words of the whole text. target: the source's budget in words, at most max_epochs times its size. taken: all
    complete epochs of the source first; the fraction that is left goes to documents in the order of their keys, and
    the document that the budget ends in gives only its first words up to it, so a source takes its target to the
    nearest word and no document exceeds max_epochs (rounded up) times its size. weight: the document's quality, above 0
    (a classifier's score, for one), from a column of docs; null and what is not above LEAST_WEIGHT count as that. Without
    it, quality_weight of the text.

    Null text: size 0, taken 0. Null source: a source of its own, last. Rows with equal id and text tie in their key
    and are ordered by size; whichever of two equal rows comes first, the rows of the result are the same. Null ids
    draw by their text. Other columns are not read. Empty table: empty result.
    """
    text = F.col("text")
    slim = materialise(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.expr(rf"size(regexp_extract_all(text, r'{WORD}', 0))"), F.lit(0)).cast("long").alias("size"),
            (quality_weight(text) if weight is None else F.greatest(F.lit(LEAST_WEIGHT), weight.cast("double"))).alias("weight"),
            _uniform(seed, F.col("doc_id"), text).alias("u"),
        ),
        "mix",
    ).withColumn("key", -F.log("u") / F.col("weight"))
    slim = _in_ranges(slim, ranges)
    targets = _source_targets(slim, weights, share, max_epochs).select(
        F.col("source").alias("t_source"), "source_size", "target"
    )
    per_range = slim.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        F.col("source").alias("r_source"),
        F.col("range").alias("r_range"),
        F.coalesce(F.sum("range_size").over(in_order), F.lit(0)).alias("start"),
    )
    # The budget of a source is known per range, so the rows meet it once, in the join that the window also needs.
    starts = starts.join(targets, F.col("r_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rows = slim.join(
        starts, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range"))
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    rows = rows.withColumn(
        "before",
        F.col("start")
        + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs.cast("long")).withColumn(
        "left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast(T.LongType())
    )
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - F.col("before")))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        "weight",
    )
