"""URL filter: rules first, and for URLs that no rule fits, gradient-boosted trees on lexical features, trained from the
URLs that the rules label. DataFrame functions and pyspark.ml only.

The trees are fitted on at most TRAIN_ROWS labelled URLs (those with the smallest hashes); the suffix statistics are
counted over all labelled URLs. Rules compile into one expression, so judging is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: (verdict, host, path): fixed values of the production rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: The bound of the sample that trees are fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 8, 3, 7
#: Suffixes that may be broadcast; more are joined by a shuffle.
SUFFIX_ROWS = 100_000

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digit_ratio",
    "f_entropy", "f_params", "f_param_length", "f_fragment", "f_hyphens", "f_longest_part", "f_suffix_rate",
    "f_suffix_count",
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = None
    for verdict, r_host, r_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == r_host) | host.endswith(f".{r_host}")) & path.startswith(r_path)
        value = F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    n = F.length(text).cast("double")

    def bits(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda s, c: s + bits(c))).otherwise(0.0)


def _lexical(rows: DataFrame) -> DataFrame:
    """Adds the features of the URL itself and `suffix`, the host's last label; rows have url, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    count = lambda text, kept: F.length(F.regexp_replace(text, kept, "")).cast("double")
    share = lambda text, kept: count(text, kept) / F.greatest(F.length(text), F.lit(1))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    return rows.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_path_length": F.length("path").cast("double"),
            "f_depth": F.size(parts).cast("double"),
            "f_labels": count(F.col("host"), r"[^.]") + 1.0,
            "f_digit_ratio": share(url, r"[^0-9]"),
            "f_host_digit_ratio": share(F.col("host"), r"[^0-9]"),
            "f_entropy": _entropy(url),
            "f_params": F.when(query != "", count(query, r"[^&]") + 1.0).otherwise(0.0),
            "f_param_length": F.length(query).cast("double"),
            "f_fragment": F.contains(url, F.lit("#")).cast("double"),
            "f_hyphens": count(url, r"[^-]"),
            "f_longest_part": F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).cast("double"),
        }
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages(page_id, url).

    score: the trees' probability of block, null where a rule decides. Null URLs and those without `://` have an empty
    host and path, fit no rule, and are judged by the trees like any other. Without labelled URLs of both verdicts there
    are no trees: everything that no rule fits has the verdict of the labels, or allow. Repeated rows give repeated
    rows. Other columns are not read. Empty table: empty result.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_found", _rule(RULES if rules is None else rules, F.col("host"), F.col("path")))
    rows = materialise(_lexical(rows), "urls")

    labelled = rows.where("_found is not null").withColumn("label", (F.col("_found.verdict") == "block").cast("double"))
    suffixes = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    suffixes = materialise(
        suffixes.select(
            F.col("suffix").alias("s_suffix"),
            ((F.col("blocked") + 1.0) / (F.col("n") + 2.0)).alias("f_suffix_rate"),
            F.log1p(F.col("n").cast("double")).alias("f_suffix_count"),
        ),
        "suffixes",
    )
    # A suffix that no rule has labelled counts as the labelled URLs do on the whole.
    overall = labelled.agg(F.avg("label")).first()[0]
    overall = 0.5 if overall is None else overall
    if suffixes.count() <= SUFFIX_ROWS:
        suffixes = F.broadcast(suffixes)

    def with_suffix(df: DataFrame) -> DataFrame:
        return df.join(suffixes, F.col("suffix") == F.col("s_suffix"), "left").fillna(
            {"f_suffix_rate": overall, "f_suffix_count": 0.0}
        )

    # However often a URL is there, it counts once.
    sample = labelled.select("url", "host", "path", "label").distinct().orderBy(F.xxhash64("url"), "url").limit(train_rows)
    sample = _lexical(sample)
    sample = materialise(with_suffix(sample).select("label", *FEATURES), "labelled-urls")
    classes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    out = ["page_id", "host", "path", F.col("_found.rule").alias("rule")]
    if len(classes) < 2:
        default = "block" if classes.get(1.0) else "allow"
        verdict = F.coalesce(F.col("_found.verdict"), F.lit(default))
        return rows.select(*out, verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_prediction",
        maxIter=TREES, maxDepth=DEPTH, seed=SEED,
    ).fit(assembler.transform(sample))
    judged = trees.transform(assembler.transform(with_suffix(rows)))
    score = F.when(F.col("_found").isNull(), vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_found.verdict"), F.when(F.col("_prediction") == 1.0, "block").otherwise("allow"))
    return judged.select(*out, verdict.alias("verdict"), score.alias("score"))
