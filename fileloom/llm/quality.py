"""Quality classifier by compression: zstandard dictionaries are built from good and from bad labelled texts; a text that
the good dictionary compresses better than the bad one is likelier good. The difference of the compressed sizes, over
their sum, becomes a probability by logistic calibration on labelled texts that the dictionaries have not seen.

The model (two dictionaries, a few numbers) is fitted on the driver from at most SAMPLE texts a class, and is then a
small constant that every task uses in one pass over the texts; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The bound of the labelled sample: whole texts of at most so many rows of each class, those with the smallest hashes,
#: of so many bytes each, and of so many altogether.
SAMPLE, SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 2000, 64 * 1024, 32 * 1024 * 1024
#: Size of a dictionary, and of the segments and matches that it is chosen by.
DICT_BYTES, SEGMENT, MATCH = 96 * 1024, 200, 8
LEVEL = 3
#: Texts are compressed in blocks of so many bytes, so that a dictionary counts as much in the end of a long text as
#: in its beginning; the sizes of all blocks are added.
BLOCK = 4096
THRESHOLD = 0.3
#: Part of its bytes that prose takes when it is compressed, at the least.
PROSE = 0.25
FOLDS = 5


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def held_out(doc_id: Column) -> Column:
    """Null ids hash as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _compressors(model: QualityModel):
    return [
        zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=_dictionary(d),
            write_content_size=False,
            write_dict_id=False,
            write_checksum=False,
        )
        for d in (model.good, model.bad)
    ]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    found = zstandard.ZstdCompressionDict(data)
    found.precompute_compress(level=LEVEL)
    return found


def _features(text: str | None, compressors) -> tuple[float, float]:
    """1, the normalised difference of compressed sizes (above 0: nearer to the good texts), which shrinks towards 0 as a
    text gets too short to tell. With the good dictionary a block counts as PROSE of its bytes at least: no prose gets
    smaller, and what repetition alone saves speaks for the bad side."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 1.0, 0.0
    good = bad = 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        good += max(len(compressors[0].compress(block)), PROSE * len(block))
        bad += len(compressors[1].compress(block))
    known = len(data) / (len(data) + 100.0)
    return 1.0, known * (bad - good) / (bad + good)


def _calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _train_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text for that, the text itself."""
    blocks = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, k=SEGMENT, d=MATCH, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICT_BYTES] or b" " * 8


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_bytes: int = SAMPLE_TEXT_BYTES, all_bytes: int = SAMPLE_BYTES
) -> QualityModel:
    """From labelled rows outside the held-out fold alone. sample: texts of each class at most; text_bytes: longer texts
    are not learnt from; all_bytes: of both classes, in the order of their hashes. labels(doc_id, quality); other values of quality than 0 and 1
    are left out. Calibrated for the share of good rows among all labels of the fold. With no labels of a class every
    text scores that share (0.5 if there are none)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.select("doc_id", "quality").distinct()
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    # At most 2 * sample rows of two numbers: bounded by the parameter.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # However often a document is there, it counts once.
    rows = rows.where(F.octet_length("text") <= text_bytes).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    # A window over 2 * sample rows at most.
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("so_far", F.sum(F.octet_length("text")).over(so_far)).where(F.col("so_far") <= all_bytes)
    found = rows.select("doc_id", "quality", "text").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in found.columns)))
    texts = {q: [t.encode("utf-8", "surrogatepass") for _, k, t in rows if k == q] for q in (0, 1)}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    prior = float(np.log(share / (1 - share)))
    # Every other text for the dictionaries, the rest for the calibration.
    model = QualityModel(_train_dictionary(texts[1][::2]), _train_dictionary(texts[0][::2]), (prior, 0.0))
    rest = [(t, q) for q in (0, 1) for t in texts[q][1::2]]
    if not texts[0][1::2] or not texts[1][1::2]:
        return model
    compressors = _compressors(model)
    x = np.array([_features(t.decode("utf-8", "surrogatepass"), compressors) for t, _ in rest])
    y = np.array([q for _, q in rest], float)
    w = _calibrate(x, y)
    # The sample has equal classes, as far as there are rows; the score is for the labels' own share.
    w[0] += prior - float(np.log(y.mean() / (1 - y.mean())))
    return QualityModel(model.good, model.bad, tuple(map(float, w)))


def _score(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Only texts go to Python, and only scores come back."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors, w = _compressors(shared.value), np.array(shared.value.weights)
        for texts in batches:
            x = np.array([_features(t, compressors) for t in texts]).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text).

    The score is of the whole text alone. A null or empty text has no difference of sizes, and gets the calibrated
    score of none. Equal texts have equal scores. Repeated rows give repeated rows; other columns are not read. Null
    ids count as held out or not by the hash of the empty text. Empty tables: no rows, or the scores of fit_quality.
    """
    model = fit_quality(docs, labels, sample)
    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), _score(docs.sparkSession, model, F.col("text")).alias("_score")
    )
    return rows.select(
        "doc_id",
        "held_out",
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train: DataFrame | None = None) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with all their columns, whatever their names. train: the documents
    of the labels, if they are not docs. Null and empty texts have the score of none; repeated rows stay or go together;
    without labels everything scores 0.5 and stays; an empty table stays empty."""
    model = fit_quality(docs if train is None else train, labels, sample)
    rows = docs.select(F.struct("*").alias("_row"), _score(docs.sparkSession, model, F.col("text")).alias("_score"))
    return rows.where(F.col("_score") >= THRESHOLD).select("_row.*")
