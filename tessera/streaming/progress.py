"""Progress of a multi-model tool from its output lines, and merging of event intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What the tool prints.
BAR, BAG = r"^\s*(\d{1,3})%\|", r"bag of (\d+) models"


def progress(lines: DataFrame) -> DataFrame:
    """lines (job_id, seq, stream, line) with n_models, model_index, last_pct and fraction after each.

    A model has ended when a 0 % follows a 100 %, however often that is
    printed. At each 0 % it is enough to see whether a 100 % came since the
    0 % before it, so the fold is two running windows.
    """
    by = Window.partitionBy("job_id").orderBy("seq")
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    number = lambda pattern, stream: F.when(F.col("stream") == stream, F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast("int"))
    rows = lines.withColumn("bag", number(BAG, "out")).withColumn("pct", number(BAR, "err"))
    rows = rows.withColumn("full", F.count_if(F.col("pct") == 100).over(so_far))
    rows = rows.withColumn("since", F.coalesce(F.max(F.when(F.col("pct") == 0, F.col("full"))).over(before), F.lit(0)))
    rows = rows.withColumn("next", F.when((F.col("pct") == 0) & (F.col("full") > F.col("since")), 1).otherwise(0))
    rows = rows.withColumn("n_models", F.coalesce(F.last("bag", ignorenulls=True).over(so_far), F.lit(1)))
    rows = rows.withColumn("model_index", F.least(F.sum("next").over(so_far), F.col("n_models") - 1).cast("int"))
    rows = rows.withColumn("last_pct", F.coalesce(F.last("pct", ignorenulls=True).over(so_far), F.lit(0)))
    fraction = F.least(F.lit(1.0), (F.col("model_index") + F.col("last_pct") / 100.0) / F.col("n_models"))
    label = F.concat_ws("/", F.least(F.col("model_index") + 1, F.col("n_models")), F.col("n_models"))
    return rows.select("job_id", "seq", "n_models", "model_index", "last_pct", fraction.alias("fraction"), label.alias("label"))


def session_intervals(events: DataFrame, key: str, time: str, pad_seconds: int, delay: str | None = "0 seconds") -> DataFrame:
    """Union of [time - pad, time + pad] for each key, batch or stream: such intervals meet when times are at most 2 pads apart.

    On a stream a session leaves the state once the watermark has passed it;
    without a delay there is no watermark, for complete output.
    """
    rows = events.withWatermark(time, delay) if events.isStreaming and delay else events
    gap = F.session_window(time, f"{2 * pad_seconds} seconds")
    pad = F.expr(f"INTERVAL {pad_seconds} SECONDS")
    return rows.groupBy(key, gap).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).select(key, (F.col("first") - pad).alias("start"), (F.col("last") + pad).alias("end"), "n")
