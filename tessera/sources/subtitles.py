"""Subtitle files: blocks of a number, a line of two times and lines of text, with blank lines between them.

The reader takes lines as records, so Spark splits large files anywhere, and
counts blank lines along each file to put lines together to blocks again. (With
two line feeds as the end of a record, a split that ends behind a single one
would read the record behind it too, as does the next split.) A block that
can't be read becomes a row with an error and its raw text, and nothing is
dropped. Files may begin with a byte order mark, numbers may be missing or
wrong, hours may have more than two digits, fractions one to three digits after
a comma or a dot, and the line of times may end with positions. Text is kept as it
stands, with line feeds between its lines. Empty files have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scan import Ordered

#: What a line of times looks like.
TIMES = r"^\s*(\d+):(\d\d):(\d\d)(?:[,.](\d{1,3}))?\s*-->\s*(\d+):(\d\d):(\d\d)(?:[,.](\d{1,3}))?(?:\s+(\S.*?))?\s*$"
BLANK = r"\n(?:[ \t]*\n)+"


def _ms(line: Column, group: int) -> Column:
    part = lambda i: F.regexp_extract(line, TIMES, group + i)
    hours, minutes, seconds = (part(i).try_cast("long") for i in range(3))
    return ((hours * 60 + minutes) * 60 + seconds) * 1000 + F.rpad(part(3), 3, "0").try_cast("long")


def parse_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    """blocks with cue_index, start, end (milliseconds), position, text and error in place of the block; error and raw are null where the other is what matters."""
    lines = F.split(F.btrim(F.col(block), F.lit("\n")), "\n")
    at = F.when(F.get("__lines", F.lit(0)).rlike(TIMES), 0).when(F.get("__lines", F.lit(1)).rlike(TIMES), 1)
    times = F.get("__lines", F.col("__at"))
    first = F.when(F.col("__at") == 1, F.trim(F.get("__lines", F.lit(0))))
    text = F.array_join(F.slice("__lines", F.col("__at") + 2, F.greatest(F.size("__lines") - F.col("__at") - 1, F.lit(0))), "\n")
    rows = blocks.withColumn("__lines", lines).withColumn("__at", at)
    rows = rows.withColumn("cue_index", first.try_cast("int")).withColumn("start", _ms(times, 1)).withColumn("end", _ms(times, 5))
    error = (
        F.when(F.col("__at").isNull(), "no line of times").when(F.col("start").isNull() | F.col("end").isNull(), "times out of range")
        .when((first != "") & F.col("cue_index").isNull(), "no number").when(F.col("end") < F.col("start"), "ends before it starts")
    )
    rows = rows.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    position = F.nullif(F.regexp_extract(times, TIMES, 9), F.lit(""))
    rows = rows.withColumn("position", good(position)).withColumn("text", good(text)).withColumn("raw", F.when(F.col("error").isNotNull(), F.col(block)))
    rows = rows.withColumn("cue_index", good(F.col("cue_index"))).withColumn("start", good(F.col("start"))).withColumn("end", good(F.col("end")))
    return rows.drop("__lines", "__at", block)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each block: file, the columns of folders like job_id=7, split_start and at (which order a file's blocks), and those of parse_blocks."""
    records = spark.read.text(path)
    folders = [c for c in records.columns if c != "value"]
    own = records.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("at"))
    blank = F.btrim("value", F.lit(" \t")) == ""
    lines = Ordered.of(own, ["file"], ["split_start", "at"]).scan("__block", "sum", blank.cast("long")).rows.where(~blank)
    line = F.struct("split_start", "at", "value")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = lines.repartition(parts, "file", *folders, "__block").groupBy("file", *folders, "__block").agg(F.array_sort(F.collect_list(line)).alias("__lines"))  # of one block
    text = F.regexp_replace(F.array_join(F.transform("__lines", lambda x: x["value"]), "\n"), "^﻿", "")
    return parse_blocks(blocks.select(*folders, "file", F.col("__lines")[0]["split_start"].alias("split_start"), F.col("__lines")[0]["at"].alias("at"), text.alias("block")))


def clock(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, ms % 1000)


def subtitle_block(number: Column, start: Column, end: Column, text: Column, position: Column | None = None) -> Column:
    """A block, without the blank line behind it; blank lines inside the text, which would end it, go."""
    times = F.concat_ws(" ", clock(start), F.lit("-->"), clock(end), *([position] if position is not None else []))
    inside = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "\n"), F.lit("\n"))
    return F.concat_ws("\n", number.cast("string"), times, inside)


def write_subtitles(blocks: DataFrame, path: str, key: str, order: list[str], block: str = "block") -> None:
    """A folder for each value of key, with its blocks in order in one file; blocks stream through a task and are never gathered."""
    rows = blocks.repartition(key).sortWithinPartitions(key, *order)
    rows.select(key, block).write.partitionBy(key).option("lineSep", "\n\n").text(path)
