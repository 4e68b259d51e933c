"""Sinks: one folder for each relation, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RELATIONS = ("words", "matches", "overrides", "redaction_log", "intervals", "jobs", "job_steps")
CURRENT = "_current"


def _folder(root: str, relation: str) -> str:
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    return f"{root.rstrip('/')}/{relation}"


def write(df: DataFrame, root: str, relation: str, *, fmt: str = "parquet", by: list[str] | None = None) -> str:
    """Replaces a relation and returns the folder of its rows; `by` are columns to partition by, for words the job.

    The rows go to a new folder. Once they are all there, a small file that names
    it takes the place of the one before in one rename, so readers (read) see the
    old rows or the new ones, also if the writer dies. Older folders stay until
    clean.
    """
    folder = _folder(root, relation)
    version = uuid.uuid4().hex
    if by is None:
        by = [c for c in ("job_id",) if relation == "words" and c in df.columns]
    df.write.format(fmt).partitionBy(*by).save(f"{folder}/{version}")
    fs, path = _files(df.sparkSession, folder)
    out = fs.create(path(f"{folder}/{CURRENT}-{version}"), True)
    out.writeUTF(f"{fmt}/{version}")
    out.close()
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs
    options = df.sparkSession._sc._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri()).rename(path(f"{folder}/{CURRENT}-{version}"), path(f"{folder}/{CURRENT}"), options)
    return f"{folder}/{version}"


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and how it names paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _version(spark: SparkSession, folder: str) -> tuple[str, str]:
    fs, path = _files(spark, folder)
    if not fs.exists(path(f"{folder}/{CURRENT}")):
        raise FileNotFoundError(f"nothing has been written to {folder}")
    file = fs.open(path(f"{folder}/{CURRENT}"))
    fmt, version = file.readUTF().split("/")
    file.close()
    return fmt, version


def read(spark: SparkSession, root: str, relation: str) -> DataFrame:
    """The rows that were written last."""
    folder = _folder(root, relation)
    fmt, version = _version(spark, folder)
    return spark.read.format(fmt).load(f"{folder}/{version}")


def clean(spark: SparkSession, root: str, relation: str) -> None:
    """Deletes the folders of older rows; nobody may be reading them."""
    folder = _folder(root, relation)
    _, version = _version(spark, folder)
    fs, path = _files(spark, folder)
    for status in fs.listStatus(path(folder)):
        if status.getPath().getName() not in (version, CURRENT):
            fs.delete(status.getPath(), True)


def append_failure(steps: DataFrame, root: str) -> str:
    """Adds failure events (job_id, step, seq, done, error, traceback) to the log of steps, a folder that only grows."""
    path = f"{root.rstrip('/')}/job_failures"
    steps.write.mode("append").parquet(path)
    return path
