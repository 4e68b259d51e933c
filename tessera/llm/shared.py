"""Helpers that the operators share: Arrow mapping over texts and tables in the shared folder."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.text import PIECE, pieces
from tessera.sources.tables import shared_folder

#: Spark's bound on the bytes of a batch that goes to Python, the value it has unless set, and the bound used here instead.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_UNSET, BATCH_BYTES = "67108864b", "4194304b"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and Spark hold of a batch at once, unless the session has its own bound."""
    if spark.conf.get(BATCH, None) == BATCH_UNSET:
        spark.conf.set(BATCH, BATCH_BYTES)


def others(df: DataFrame, out: list[str]) -> list[str]:
    """The columns of df that an operator keeps: those whose names its own results don't take."""
    taken = {c.lower() for c in out}
    return [c for c in df.columns if c.lower() not in taken]


def give_back() -> None:
    """Returns freed memory to the system: of workers, which Spark keeps for later tasks, and of a driver after a large step."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], limit: int = PIECE) -> DataFrame:
    """Adds columns computed from the text column, a bounded piece of a batch at a time.

    make() is called once in each task and gives a function from an Arrow
    string array to one Arrow array for each of the new fields.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            source = batch.column(text)
            for lo, hi in pieces(source, limit):
                new = kernel(source.slice(lo, hi - lo))
                old = [batch.column(c).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip([*old, *new], arrow, strict=True)], schema=arrow)
        give_back()

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow for functions that yield dicts of column name to array-like."""
    small_batches(df.sparkSession)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in make(batches):
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


#: Spark's setting that drops the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), {"n": 0, "before": "false"}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any thread is within; the last one out puts back what was set."""
    with _lock:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(CLEANUP, "false")
        _writers["n"] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(CLEANUP, _writers["before"])


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and not again if executors are lost.

    As the table takes the place of the query, its shuffle files go at once.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    with _cleaning(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def spent(*tables: DataFrame) -> None:
    """Deletes saved tables that no one will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, size: int, each: int = 128 << 20) -> int:
    """How many tasks an exchange over that many bytes gets: what the session says, and more where a task would get more than `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df, a computed table, has at most that many rows."""
    return df.limit(rows + 1).count() <= rows


def hint(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most that many rows; else Spark shuffles it."""
    return F.broadcast(df) if bounded(df, rows) else df


def small(df: DataFrame, weight: Column | int, limit: int = 8 << 20) -> DataFrame:
    """df, a computed table, marked for broadcast if its rows' weights in bytes add up to at most the limit, and else against it.

    Left alone, Spark would broadcast tables of up to 10 MB on disk, which are
    many times that in the driver's memory.
    """
    size = df.count() * weight if isinstance(weight, int) else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df.hint("merge")
