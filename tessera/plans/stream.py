"""The streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import metadata  # noqa: F401
from tessera.plans.registry import SQL, query, table
from tessera.streaming.run import all_sessions, landed_sessions

PAD = 600_000_000


@query("interval_stream", SQL["interval_sessions"])
def interval_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream, each written once, when the watermark has passed it; those still open come from its state."""
    rows = all_sessions(spark, sf_dir, "events.parquet", 1200).where("kind <> 'late'")
    return rows.select(F.col("key").alias("user_id"), (F.col("first") - PAD).alias("start_us"), (F.col("last") + PAD).alias("end_us"), "n")


@query(
    "late_sessions",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id * 2 // (SELECT count(*) FROM events) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS b FROM events),
    m AS (SELECT b, max(t // 1000) AS m FROM e GROUP BY b),
    w AS (SELECT b, coalesce(max(m) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000, 0) AS mark FROM m),
    x AS (SELECT user_id, t, t // 1000000 * 1000000 < mark * 1000 AS late FROM e JOIN w USING (b)),
    o AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1200000000 THEN 0 ELSE 1 END AS o FROM x WHERE NOT late),
    g AS (SELECT user_id, t, sum(o) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM o)
    SELECT 'session' AS kind, user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM g GROUP BY user_id, g
    UNION ALL SELECT 'late', user_id, min(t), max(t), count(*) FROM x WHERE late GROUP BY user_id""",
)
def late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose events land in three parts, a tenth of them one part too late: its sessions, and each user's late events."""
    events = table(spark, sf_dir, "events")
    part = F.floor(F.col("event_id") * 2 / events.count()) + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    own = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), part.alias("part"))
    rows = landed_sessions([own.where(F.col("part") == p).drop("part") for p in range(3)], 1200, 3600)
    late = rows.where("kind = 'late'").groupBy("kind", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    every = rows.where("kind <> 'late'").withColumn("kind", F.lit("session")).unionByName(late)
    return every.select("kind", F.col("key").alias("user_id"), F.col("first").alias("first_us"), F.col("last").alias("last_us"), "n")
