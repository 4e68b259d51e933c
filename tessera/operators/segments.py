"""Fixed-size segments and the merging of their transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import to_grid


def segment_bounds(jobs: DataFrame, size: Column | int) -> DataFrame:
    """Segments (segment_index from 1, start, end) of jobs with a duration; one whole segment if size is 0 or not exceeded."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.when((size <= 0) | (F.col("duration") <= size), 1).otherwise(F.ceil(F.col("duration") / F.nullif(size, F.lit(0))))
    rows = jobs.withColumn("__size", size).withColumn("segment_index", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    start = F.when(F.col("__size") > 0, (F.col("segment_index") - 1) * F.col("__size")).otherwise(0)
    end = F.when(F.col("__size") > 0, F.least(F.col("segment_index") * F.col("__size"), F.col("duration"))).otherwise(F.col("duration"))
    return rows.withColumn("start", start.cast("long")).withColumn("end", end.cast("long")).drop("__size")


def segment_durations(segments: DataFrame) -> DataFrame:
    """segments (job_id, segment_index, start, duration of the job) with length: up to the next start, the last up to the end."""
    by = Window.partitionBy("job_id").orderBy("segment_index")
    return segments.withColumn("length", F.coalesce(F.lead("start").over(by), F.col("duration")) - F.col("start"))


def flatten_words(transcripts: DataFrame) -> DataFrame:
    """Rows of segment transcripts whose `segments` nest words: words in order, empty ones dropped."""
    flat = F.filter(F.flatten(F.transform(F.coalesce("segments", F.array().cast(transcripts.schema["segments"].dataType)), lambda s: s["words"])), lambda w: w["word"].isNotNull() & (w["word"] != ""))
    return transcripts.withColumn("words", flat).drop("segments")


def zip_segments(segments: DataFrame, *others: DataFrame) -> DataFrame:
    """The n-th segment of a job (job_id, segment_index, ...) with the n-th row of each other relation; pairing stops at the shortest.

    The others have a segment_index of their own, which orders them; of columns
    with the same name the segment's stays.
    """
    by = Window.partitionBy("job_id").orderBy("segment_index")
    out = segments.withColumn("__n", F.row_number().over(by))
    for other in others:
        fresh = [c for c in other.columns if c not in out.columns]
        out = out.join(other.withColumn("__n", F.row_number().over(by)).select("job_id", "__n", *fresh), ["job_id", "__n"])
    return out.drop("__n")


def merge_transcripts(words: DataFrame) -> DataFrame:
    """Words of all segments (job_id, segment_index, pos, word, start, end, score, offset) on one timeline, numbered from 0.

    The offset comes from the segment list (zip_segments); null times stay null.
    """
    by = Window.partitionBy("job_id").orderBy("segment_index", "pos")
    shifted = words.withColumn("start", to_grid(F.col("start") + F.col("offset"))).withColumn("end", to_grid(F.col("end") + F.col("offset")))
    return shifted.withColumn("word_index", F.row_number().over(by) - 1)


def transcript_totals(words: DataFrame) -> DataFrame:
    """Word counts for each segment, with the job's total in a row without a segment."""
    return words.rollup("job_id", "segment_index").agg(F.count("*").alias("n_words")).where("job_id is not null")


def transcription_totals(segments: DataFrame) -> DataFrame:
    """For each job the words of its transcribed segments (word_count), a missing count being 0."""
    return segments.groupBy("job_id").agg(F.sum(F.coalesce("word_count", F.lit(0))).alias("total_words"))


def total_durations(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each job its known duration (total), or the sum of its segments' durations where that is missing or 0."""
    sums = segments.groupBy("job_id").agg(F.sum(F.coalesce("duration", F.lit(0))).alias("summed"))
    known = F.nullif(F.col("total"), F.lit(0))
    return jobs.select("job_id", "total").join(sums, "job_id", "left").select("job_id", F.coalesce(known, "summed", F.lit(0)).alias("total"))


def last_language(transcripts: DataFrame, default: str = "en") -> DataFrame:
    """The language of the last segment that names one."""
    named = F.when(F.col("language").isNotNull(), F.col("segment_index"))
    return transcripts.groupBy("job_id").agg(F.coalesce(F.max_by("language", named), F.lit(default)).alias("language"))
