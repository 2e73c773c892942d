"""What the operators of this package share: table paths, words, and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: The folder of the job that is under way, if it removes its intermediate tables.
_JOB: ContextVar[str | None] = ContextVar("job", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a folder of our own, for a driver that
    is its own executor alone: on a cluster there is no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-fileloom-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def tables_folder(spark: SparkSession) -> str:
    return _JOB.get() or shared_dir(spark)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of the operators that run within this are removed at its end: what they return has to be written
    elsewhere by then."""
    folder = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    token = _JOB.set(folder)
    try:
        yield
    finally:
        _JOB.reset(token)
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages don't compute it anew, and survive the
    loss of the executors that made it."""
    path = f"{tables_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one job, by name, in one folder. Those that nothing reads any more can be removed."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder = spark, f"{tables_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def free_shuffles(self) -> None:
        """Spark removes the shuffle files of jobs that are over when the driver has collected what stands for them, which
        may take as long as the whole job: now they go at once."""
        self.spark._jvm.System.gc()

    def remove(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.folder}/{name}")


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() is the same for text that is all ASCII, and much faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def whole_row(df: DataFrame) -> DataFrame:
    """The row as one struct beside its text: columns that are added can't clash with those of the input."""
    return df.select(F.struct("*").alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
