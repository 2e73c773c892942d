"""The corpus pipeline: documents go through the stages in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fileloom.llm import decontam, jaccard, mixing, quality, rules
from fileloom.llm.common import Tables, job, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), train=table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep_by_rules(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document of sf_dir that all stages keep. Each stage's result is written before the next
    one reads it, and then what the stage and the one before it have written is removed, but for what the result of the
    last stage still reads.

    Rows that repeat id and text, and similar texts, leave one row (that with the smallest id, null last). Null, empty and
    wordless texts go with the rules. A null lang or source is a value like any other, a null id a document like any
    other. Without labels the classifier keeps all, without benchmark items the decontamination does. Columns that are
    not read are carried along, whatever their names, up to the mix. Empty tables: an empty result; reruns agree."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with job(spark):
            docs = tables.save(stage(spark, docs, sf_dir), f"stage-{i}")
        tables.remove(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier's dictionaries have no SQL.
ORACLE_SQL = None
