"""Sessions of a stream with late data.

Events of a key belong to one session while they are at most `gap` apart. Rows
are merged by key and second within each batch before they are shuffled, then
a stateful operator keeps a key's open sessions and nothing else: a session
leaves the state, and is written once, when the watermark has passed its end
by more than the gap. A row is late if its second began before the watermark that its batch starts
with; late rows are written with kind `late` and change no session, and none is
dropped in silence. Spark itself would drop them before the operator, so the
time that goes on to it is not the one that carries the watermark.

Each batch's rows go to a folder of their own, named by the batch and replaced
as a whole, so a batch that is run again after a failure gives the same rows
once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OPEN = "first long, last long, n long"
FOUND = f"kind string, key long, {OPEN}"
SECOND = 1_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of sessions that are at most gap apart made one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(sessions):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Sessions(StatefulProcessor):
    """Open sessions of a key, in a list state; one timer, for the end of that which ends first."""

    def __init__(self, gap: int) -> None:
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        known, fresh, late = [tuple(x) for x in self.open.get()], [], []
        for batch in rows:
            for first, last, n in zip(batch["first"].tolist(), batch["last"].tolist(), batch["n"].tolist(), strict=True):
                (late if first // SECOND * SECOND < mark else fresh).append((first, last, n))
            fresh = merged(fresh, self.gap)
        if fresh:
            every = merged(known + fresh, self.gap)
            self.open.put(every)
            self.wake(every, min((self.expiry(s[1]) for s in known), default=None))
        if late:
            yield self.rows("late", key, late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        known = [tuple(x) for x in self.open.get()]
        done = [s for s in known if self.expiry(s[1]) <= mark]
        if done:
            left = [s for s in known if self.expiry(s[1]) > mark]
            if left:
                self.open.put(left)
            else:
                self.open.clear()
        else:
            left = known  # what it was for has grown since
        if left:
            self.wake(left)
        if done:
            yield self.rows("session", key, done)

    def wake(self, every: list[tuple[int, int, int]], set_for: int | None = None) -> None:
        """A timer for the end of the session that ends first, unless there is one. One for each session would be a call for each of them, twice."""
        first = min(self.expiry(s[1]) for s in every)
        if first != set_for:
            self.handle.registerTimer(first)

    def expiry(self, last: int) -> int:
        """The watermark, in milliseconds, from which on no row can be near enough."""
        return (last + self.gap) // 1000 + 1000

    @staticmethod
    def rows(kind: str, key: tuple, sessions: list[tuple[int, int, int]]) -> pd.DataFrame:
        first, last, n = zip(*sessions, strict=True)
        return pd.DataFrame({"kind": kind, "key": int(key[0]), "first": first, "last": last, "n": n})

    def close(self) -> None:
        pass


def _by_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key and second of a batch as one."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).append_column("second", pa.array(batch.column("at").to_numpy() // SECOND))
        found = table.group_by(["key", "second"]).aggregate([("at", "min"), ("at", "max"), ("at", "count")])
        yield from pa.table({"key": found["key"], "first": found["at_min"], "last": found["at_max"], "n": found["at_count"].cast(pa.int64())}).to_batches()


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, delay_seconds: int) -> DataFrame:
    """The stream of (kind, key, first, last, n), times in microseconds: closed sessions and late rows. Rows without a key or a time take no part."""
    marked = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, f"{delay_seconds} seconds")
    plain = marked.select(F.col(key).cast("long").alias("key"), F.unix_micros(time).alias("at"))
    dealt = plain.mapInArrow(_by_second, "key long, first long, last long, n long")
    return dealt.groupBy("key").transformWithStateInPandas(Sessions(gap_seconds * 1_000_000), outputStructType=FOUND, outputMode="Append", timeMode="EventTime")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream's state holds: sessions that its watermark has not passed yet."""
    state = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").load(checkpoint)
    return state.select(F.lit("open").alias("kind"), F.col("key.key").alias("key"), *[F.col(f"list_element.{c}").alias(c) for c in ("first", "last", "n")])


def run_sessions(events: DataFrame, key: str, time: str, gap_seconds: int, delay_seconds: int, folder: str, written: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs the stream until it has caught up; rows are in folder/rows, its state in folder/state. A later call goes on where this one ended."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if written:
            written(batch, number)

    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        found = sessions(events, key, time, gap_seconds, delay_seconds)
        found.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def session_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Closed sessions and late rows so far, and sessions that are open."""
    closed = spark.read.schema(f"{FOUND}, batch long").parquet(f"{folder}/rows").drop("batch")
    return closed.unionByName(open_sessions(spark, f"{folder}/state"))
