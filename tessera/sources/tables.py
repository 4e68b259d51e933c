"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share.

    The cluster names that place in spark.checkpoint.dir; only where it is
    unset, as in tests on one machine, a local folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once for all its readers, and not again if executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 128 << 20, each: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df, dealt out to all cores if it is a table of at most `most` bytes in fewer files than there are cores.

    A small file often is a single row group, which one core would have to read
    and process alone. Larger tables are left as they lie, unless `each` is given:
    then they are dealt out to tasks of at most that many of the table's bytes,
    for texts from which many times their bytes are made. by names columns to deal out by, for a join that follows.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = cores if size <= most or not each else max(cores, -(-size // each))
    if (size > most and not each) or len(df.inputFiles()) >= parts:
        return df
    return df.repartition(parts, *by)
