"""Readers and writers of the interchange formats, all with fixed schemas."""

from __future__ import annotations

import os
import warnings
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = "array<struct<word:string,start:double,end:double,score:double>>"
TRANSCRIPT = f"language string, segment_index int, segment_start_offset double, words {WORDS}, segments array<struct<words:{WORDS}>>"
MATCHES = "word_index int, span int, matched_text string, entry string, start double, end double, score double"
OVERRIDES = "action string, word_index int, text string, start double, end double"
LOG = "source string, word string, entry string, word_index int, start double, end double, padded_start double, padded_end double, score double"
JOB = "job_id string, input_path string, input_filename string, started_at string, started_at_local string, status string, steps_completed array<string>, config_snapshot string, failure struct<step:string,error:string,traceback:string>"
STREAM = "codec_name string, profile string, bit_rate string, sample_rate string, channels int, channel_layout string, duration string, tags map<string,string>"
PROBE = f"streams array<struct<{STREAM.replace(' map', ':map').replace(' string', ':string').replace(' int', ':int')}>>, format struct<duration:string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document for each file; job_dir is the folder it lies in."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("job_dir", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, TRANSCRIPT)


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """Words of transcripts, numbered from 0 in array order."""
    return transcripts.select("job_dir", "language", "segment_index", F.posexplode("words").alias("word_index", "w")).select("job_dir", "language", "segment_index", "word_index", "w.word", "w.start", "w.end", "w.score")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    inner = MATCHES.replace(" ", ":").replace(",:", ",")
    return _json(spark, path, f"matches array<struct<{inner}>>").select("job_dir", F.explode("matches").alias("m")).select("job_dir", "m.*")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    inner = OVERRIDES.replace(" ", ":").replace(",:", ",")
    return _json(spark, path, f"overrides array<struct<{inner}>>").select("job_dir", F.explode("overrides").alias("o")).select("job_dir", "o.*")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job documents with path; those that can't be parsed have only corrupt set."""
    df = spark.read.schema(JOB + ", corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return df.withColumn("path", F.input_file_name())


def corrupt_jobs(jobs: DataFrame) -> DataFrame:
    """(path, corrupt) of the job documents that can't be parsed."""
    return jobs.where("corrupt is not null and job_id is null").select("path", "corrupt")


def find_job(jobs: DataFrame, job_id: str, warn: bool = True) -> DataFrame:
    """The first job document with that id in path order; documents that can't be parsed can't match, and the first few are named in a warning."""
    if warn and (bad := [r.path for r in corrupt_jobs(jobs).orderBy("path").limit(20).collect()]):
        warnings.warn(f"unreadable job documents were passed over while looking for {job_id}: {', '.join(bad)}", stacklevel=2)
    return jobs.where(F.col("job_id") == job_id).orderBy("path").limit(1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, line) of a small text file; whole files keep their line order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select((F.col("n") + 1).alias("line_no"), "line")


def resolve_lexicon(configured: str | None, default: str | Path) -> str:
    """The configured word list if it exists, else the default one; an error if neither does."""
    for path in (configured, default):
        if path and os.path.exists(path):
            return str(path)
    raise FileNotFoundError(f"no word list at {configured!r} or {str(default)!r}")


def read_probe(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Probe documents in a text column: the first audio stream, and the duration of the stream or else of its container.

    strict: a document without a stream, or without any duration, is an error as
    soon as that column is used; else it gives null.
    """
    parsed = F.from_json(column, PROBE)
    stream = F.get(parsed["streams"], F.lit(0))
    length = F.coalesce(stream["duration"].try_cast("double"), parsed["format"]["duration"].try_cast("double"))
    if strict:
        stream, length = required(stream, "no audio stream found"), required(length, "the duration can't be determined")
    return df.withColumn("stream", stream).withColumn("duration_sec", length)


def required(value: Column, message: str) -> Column:
    """value, or an error where it is null."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)))


@F.pandas_udf(T.ArrayType(T.ShortType()))
def _samples(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.frombuffer(b[: len(b) // 2 * 2], "<i2"))


def pcm_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples) of raw 16-bit little-endian PCM files; the sign is in the second byte of a sample."""
    return spark.read.format("binaryFile").load(path).select("path", _samples("content").alias("samples"))
