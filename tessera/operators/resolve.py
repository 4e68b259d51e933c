"""Overrides over matches, redaction log, interval merging, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import to_grid

JOB = "job_id"


def drop_skipped(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """Matches that don't start at a skipped index."""
    skips = overrides.where("action = 'skip'").select(JOB, "word_index").distinct()
    return matches.join(skips, [JOB, "word_index"], "left_anti")


def apply_corrections(overrides: DataFrame, matches: DataFrame, skips: DataFrame, adds: DataFrame) -> DataFrame:
    """overrides plus new skips (job_id, word_index), each once and with the text of the last match there, plus adds (job_id, text, start, end)."""
    last = matches.groupBy(JOB, "word_index").agg(F.max_by("matched_text", F.struct(F.col("span") > 1, "line_no")).alias("text"))
    known = overrides.where("action = 'skip'").select(JOB, "word_index")
    fresh = skips.select(JOB, "word_index").distinct().join(known, [JOB, "word_index"], "left_anti").join(last, [JOB, "word_index"], "left")
    checked = adds.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit("an added interval must end after it starts")).cast("double")))
    kind = dict(overrides.dtypes)
    new = fresh.select(JOB, F.lit("skip").alias("action"), "word_index", "text", F.lit(None).cast(kind["start"]).alias("start"), F.lit(None).cast(kind["end"]).alias("end"))
    add = checked.select(JOB, F.lit("add").alias("action"), F.lit(None).cast("int").alias("word_index"), "text", F.col("start").cast(kind["start"]), F.col("end").cast(kind["end"]))
    return overrides.unionByName(new).unionByName(add)


def padded_rows(matches: DataFrame, overrides: DataFrame, pad: float) -> DataFrame:
    """Matches that stay and additions, with padded bounds; seq numbers a job's matches and its additions."""
    kept = drop_skipped(matches, overrides).select(JOB, F.lit("matched").alias("source"), F.col("matched_text").alias("word"), "entry", "word_index", "start", "end", "score", F.col("match_rank").alias("seq"))
    adds = overrides.where("action = 'add'").select(JOB, F.lit("review_add").alias("source"), F.col("text").alias("word"), F.lit(None).cast("string").alias("entry"), "word_index", "start", "end")
    adds = adds.withColumn("seq", F.row_number().over(Window.partitionBy(JOB).orderBy("start", "end", "word")))
    rows = kept.unionByName(adds, allowMissingColumns=True)
    return rows.withColumn("padded_start", F.greatest(F.col("start") - pad, F.lit(0))).withColumn("padded_end", F.col("end") + pad)


def redaction_log(matches: DataFrame, overrides: DataFrame, pad: float) -> DataFrame:
    """Unmerged log rows with times on the grid of four decimals; log_rank orders a job's rows by padded start, matches before additions."""
    rows = padded_rows(matches, overrides, pad)
    for c in ("start", "end", "padded_start", "padded_end"):
        rows = rows.withColumn(c, to_grid(F.col(c)))
    by = Window.partitionBy(JOB).orderBy("padded_start", "source", "seq")
    return rows.withColumn("log_rank", F.row_number().over(by)).drop("seq")


def merge_intervals(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of closed intervals for each key: overlapping or touching ones become one. Nulls take no part."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, start, end)
    opens = rows.withColumn("__open", F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1))
    island = opens.withColumn("__island", F.sum("__open").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def muted_intervals(matches: DataFrame, overrides: DataFrame, pad: float) -> DataFrame:
    """What is muted in each job: the union of padded bounds, which are not rounded here."""
    rows = padded_rows(matches, overrides, pad)
    return merge_intervals(rows.select(JOB, F.col("padded_start").alias("start"), F.col("padded_end").alias("end")), [JOB])


def covered_words(words: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Timed words whose start lies in an interval of their job: a range join by bins of `width`."""
    return _binned(words.where("start is not null"), intervals, width, "left_semi")


def mark_covered(words: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """All words, with covered: whether the start lies in one of the job's merged intervals, of which at most one can hold it."""
    return _binned(words, intervals, width, "left").withColumn("covered", F.col("__hit").isNotNull()).drop("__hit")


def _binned(words: DataFrame, intervals: DataFrame, width: int, how: str) -> DataFrame:
    bins = intervals.select(JOB, F.col("start").alias("a"), F.col("end").alias("b")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    bins = bins.select(F.col(JOB).alias("__hit"), F.col("bin").alias("__bin"), "a", "b")
    own = words.withColumn("bin", F.floor(F.col("start") / width))
    hit = (F.col(JOB) == F.col("__hit")) & (F.col("bin") == F.col("__bin")) & F.col("start").between(F.col("a"), F.col("b"))
    # how many bins there are isn't seen in the size of the intervals' table
    return own.join(bins.hint("merge"), hit, how).drop("bin", "__bin", "a", "b")


def statistics(matches: DataFrame, overrides: DataFrame, merged: DataFrame) -> DataFrame:
    """For each job: candidates, skipped (distinct skips, whether or not they hit), added, muted_intervals."""
    parts = [
        matches.groupBy(JOB).agg(F.count("*").alias("candidates")),
        overrides.groupBy(JOB).agg(F.countDistinct(F.when(F.col("action") == "skip", F.col("word_index"))).alias("skipped"), F.count_if(F.col("action") == "add").alias("added")),
        merged.groupBy(JOB).agg(F.count("*").alias("muted_intervals")),
    ]
    out = parts[0].join(parts[1], JOB, "full").join(parts[2], JOB, "full")
    return out.select(JOB, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "skipped", "added", "muted_intervals")])
