"""Runs session streams over folders of event files until they have caught up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import shared_folder
from tessera.streaming.sessions import run_sessions, session_rows


def all_sessions(spark: SparkSession, folder: str, pattern: str, gap_seconds: int, delay_seconds: int = 3600) -> DataFrame:
    """(kind, key, first, last, n) of events (user_id, ts): closed sessions, those still open, and late rows."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    out = shared_folder(spark)
    run_sessions(events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", gap_seconds, delay_seconds, out)
    return session_rows(spark, out)


def landed_sessions(arrivals: Iterable[DataFrame], gap_seconds: int, delay_seconds: int) -> DataFrame:
    """all_sessions of events (user_id, ts) that land in a folder one table after the other; the stream stops and goes on between them."""
    arrivals = list(arrivals)
    spark = arrivals[0].sparkSession
    out = shared_folder(spark)
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{out}/in")
        run_sessions(spark.readStream.schema(rows.schema).parquet(f"{out}/in"), "user_id", "ts", gap_seconds, delay_seconds, out)
    return session_rows(spark, out)
