"""A catalog of files that follows a stream of changes by state: each id's row is kept in a state store (RocksDB, so that
it may be larger than memory), and a micro-batch reads and writes the rows of the ids that it changes and nothing else.

For logs of files alone: a renamed directory moves rows of other ids, which CatalogStore follows. What comes out is a log of
rows, each with the seq of its last change, in an append-only Parquet sink; the catalog is the last row of each id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fileloom.schema import CATALOG

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row as it is kept: large ids as text, since pandas makes floating-point numbers of them beside a null, and micros.
_COLUMNS = ["parent_id", "name", "path", "size", "micros", "is_dir", "attributes"]
_FIELDS = [T.StructField("alive", T.BooleanType()), *[T.StructField(c, T.StringType()) for c in _COLUMNS]]
_STATE = T.StructType([T.StructField("seq", T.LongType()), *_FIELDS])
LATEST = T.StructType([T.StructField("id", T.LongType()), *_STATE.fields])


def _as_text(df: DataFrame) -> DataFrame:
    """The columns of a catalog row as they are kept."""
    micros = F.unix_micros("modified").alias("micros")
    names = [micros if c == "micros" else F.col(c) for c in _COLUMNS]
    return df.select("id", *[c for c in ("seq", "kind") if c in df.columns], *[c.cast("string") for c in names])


def _as_rows(latest: DataFrame) -> DataFrame:
    rows = latest.withColumn("modified", F.timestamp_micros(F.col("micros").cast("long")))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG.fields])


class _Row(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", _STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        self.row.update((-1, True, *_texts(initialState.iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Of an id's rows in the batch only the last creation or deletion and the last rename are kept at any time."""
        seq, alive, *columns = self.row.get() if self.row.exists() else (-1, False, *[None] * len(_COLUMNS))
        newest, base, base_seq, move, move_seq = seq, None, -1, None, -1
        for frame in rows:
            # What was there before the state's last change has been seen.
            frame = frame[frame["seq"] > seq]
            if not len(frame):
                continue
            newest = max(newest, int(frame["seq"].max()))
            renames = frame["kind"] == "rename"
            for part, is_move in ((frame[~renames], False), (frame[renames], True)):
                if len(part):
                    last = part.loc[part["seq"].idxmax()]
                    if is_move and last["seq"] > move_seq:
                        move, move_seq = last, int(last["seq"])
                    elif not is_move and last["seq"] > base_seq:
                        base, base_seq = last, int(last["seq"])
        if newest == seq:
            return
        if base is not None:
            alive, columns = base["kind"] == "create", list(_texts(base))
        if alive and move_seq > base_seq:
            columns[1], columns[2] = _text(move["name"]), _text(move["path"])
        if not alive:
            columns = [None] * len(_COLUMNS)
        self.row.update((newest, bool(alive), *columns))
        yield pd.DataFrame([(key[0], newest, bool(alive), *columns)], columns=LATEST.names)

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return None if value is None or value != value else str(value)


def _texts(row: pd.Series) -> tuple[str | None, ...]:
    return tuple(_text(row[c]) for c in _COLUMNS)


def latest_rows(changes: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """A stream of LATEST rows from a stream of CHANGES rows: for each id that a batch changes, its row after it (alive:
    whether it is there). catalog: the rows that were there before the first batch. Rows of an id that come after later
    ones of it, in another batch, are dropped; a rename of what is not there does nothing but count as seen. An id that is
    gone keeps its last seq."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    initial = None if catalog is None else _as_text(catalog).groupBy("id")
    return _as_text(changes).groupBy("id").transformWithStateInPandas(_Row(), LATEST, "Append", "None", initialState=initial)


def follow_files(changes: DataFrame, folder: str, checkpoint: str, catalog: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Start following a stream of CHANGES rows of files. once: all that is there now, then stop."""
    writer = latest_rows(changes, catalog).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_files(spark: SparkSession, folder: str, catalog: DataFrame | None = None) -> DataFrame:
    """The catalog now: the last row of each id that is there, and what was there before and has never changed."""
    log = spark.read.schema(LATEST).parquet(folder)
    last = log.groupBy("id").agg(F.max_by(F.struct("alive", *_COLUMNS), "seq").alias("row")).select("id", "row.*")
    rows = _as_rows(last.where("alive"))
    return rows if catalog is None else rows.unionByName(catalog.select(*CATALOG.names).join(last, "id", "left_anti"))
