"""Queries that go through files: relations written in the interchange formats, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import segments as sg
from tessera.operators.jobs import STEPS
from tessera.plans.fixtures import MATCHES, OVERRIDES, overrides_of
from tessera.plans.registry import query, table
from tessera.plans.transcript import kept_matches
from tessera.sources import readers, writers
from tessera.sources.tables import saved, shared_folder

#: Conversations, documents or users of one job.
EACH = 25


def one_file_each(docs: DataFrame, path: str, fmt: str = "json") -> str:
    """A folder job=<n> for each row of docs (job, ...), with one document in one file; the readers take whole files as documents."""
    docs.repartition("job").write.partitionBy("job").format(fmt).save(path)
    return path


def number(folder: str) -> Column:
    return F.regexp_extract(folder, r"job=(\d+)", 1).cast("long")


@query(
    "transcript_files",
    rf"""WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+') AS w FROM conversations),
    e AS (SELECT conv_id, turn, w, unnest(range(len(w))) AS pos FROM t),
    n AS (SELECT conv_id // {EACH} AS job, *, w[pos + 1] AS word, row_number() OVER (PARTITION BY conv_id // {EACH} ORDER BY conv_id, turn, pos) - 1 AS i FROM e),
    l AS (SELECT conv_id // {EACH} AS job, min(role) AS language, CAST(count(*) AS INTEGER) AS turns FROM conversations GROUP BY 1)
    SELECT CAST(job AS BIGINT) AS job_id, language, turns AS segment_index, CAST(i AS INTEGER) AS word_index, word, CASE WHEN pos % 7 <> 6 THEN pos * 0.5::DOUBLE END AS "start", CASE WHEN pos % 7 <> 6 THEN pos * 0.5::DOUBLE + 0.25::DOUBLE END AS "end", (pos % 5) / 4.0::DOUBLE AS score FROM n JOIN l USING (job)""",
)
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript documents; those of even jobs nest their words in segments, with empty ones among them, and are flattened."""
    job = F.floor(F.col("conv_id") / EACH).alias("job")
    t = table(spark, sf_dir, "conversations").select(job, "conv_id", "turn", "role", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    start = F.when(F.col("pos") % 7 != 6, F.col("pos") * 0.5)
    word = F.struct("word", start.alias("start"), (start + 0.25).alias("end"), (F.col("pos") % 5 / 4.0).alias("score"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["w"])
    turns = t.groupBy("job", "conv_id", "turn").agg(ordered(F.struct("pos", word.alias("w"))).alias("words"))
    blank = F.array(F.struct(F.lit("").alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(1.0).alias("score")))
    docs = turns.groupBy("job").agg(ordered(F.struct("conv_id", "turn", F.struct(F.concat("words", blank).alias("words")).alias("w"))).alias("segments"), F.flatten(ordered(F.struct("conv_id", "turn", F.col("words").alias("w")))).alias("words"))
    known = table(spark, sf_dir, "conversations").groupBy(job).agg(F.min("role").alias("language"), F.count("*").cast("int").alias("segment_index"))
    even = F.col("job") % 2 == 0
    docs = docs.join(known, "job").select("job", "language", "segment_index", F.lit(0.0).alias("segment_start_offset"), F.when(~even, F.col("words")).alias("words"), F.when(even, F.col("segments")).alias("segments"))
    read = saved(readers.read_transcripts(spark, f"{one_file_each(docs, shared_folder(spark))}/*/*.json"))
    nested, flat = read.where("segments is not null"), read.where("segments is null").drop("segments")
    words = readers.transcript_words(flat.unionByName(sg.flatten_words(nested)))
    return words.withColumn("job_id", number("job_dir")).drop("job_dir")


@query("match_files", f"WITH {MATCHES} SELECT CAST(job_id // {EACH} AS BIGINT) AS job_id, line_no * 1000000 + word_index AS word_index, span, matched_text, entry, st / 1000 AS \"start\", en / 1000 AS \"end\", CAST(score AS DOUBLE) AS score FROM matches")
def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept_matches(spark, sf_dir)
    one = F.struct((F.col("line_no") * 1_000_000 + F.col("word_index")).cast("int").alias("word_index"), F.col("span").cast("int").alias("span"), "matched_text", "entry", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), F.col("score").cast("double").alias("score"))
    docs = m.groupBy(F.floor(F.col("job_id") / EACH).alias("job")).agg(F.collect_list(one).alias("matches"))
    read = readers.read_matches(spark, f"{one_file_each(docs, shared_folder(spark))}/*/*.json")
    return read.withColumn("job_id", number("job_dir")).drop("job_dir")


@query("override_files", f"WITH {OVERRIDES}, o AS (SELECT job_id, 'skip' AS action, word_index, NULL AS text, NULL AS s, NULL AS e FROM skips UNION ALL SELECT job_id, 'add', NULL, word, st / 1000, en / 1000 FROM adds) SELECT CAST(job_id // {EACH} AS BIGINT) AS job_id, action, CAST(word_index AS INTEGER) AS word_index, text, CAST(s AS DOUBLE) AS \"start\", CAST(e AS DOUBLE) AS \"end\" FROM o")
def override_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overrides_of(kept_matches(spark, sf_dir))
    one = F.struct("action", "word_index", "text", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    docs = o.groupBy(F.floor(F.col("job_id") / EACH).alias("job")).agg(F.collect_list(one).alias("overrides"))
    read = readers.read_overrides(spark, f"{one_file_each(docs, shared_folder(spark))}/*/*.json")
    return read.withColumn("job_id", number("job_dir")).drop("job_dir")


@query(
    "job_files",
    f"""WITH e AS (SELECT user_id AS job, count(*) AS n, arg_max(event_type, event_id) AS last FROM events GROUP BY 1)
    SELECT CAST(job AS BIGINT) AS folder, CASE WHEN job % 7 <> 3 THEN 'job-' || job END AS job_id, CASE WHEN job % 7 <> 3 THEN last END AS status, CASE WHEN job % 7 <> 3 THEN CAST(n % 12 AS INTEGER) END AS n_steps, CASE WHEN job % 7 <> 3 AND last = 'error' THEN {list(STEPS)}[CAST(n % 12 AS INTEGER) + 1] END AS failed, job % 7 = 3 AS unreadable FROM e""",
)
def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job documents, of which some break off and are told from the others when they are read."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("last"))
    steps, done = F.array(*map(F.lit, STEPS)), (F.col("n") % 12).cast("int")
    failure = F.when(F.col("last") == "error", F.struct(F.get(steps, done).alias("step"), F.lit("stopped").alias("error"), F.lit("").alias("traceback")))
    doc = F.to_json(F.struct(F.concat(F.lit("job-"), F.col("job").cast("string")).alias("job_id"), F.col("last").alias("status"), F.slice(steps, 1, done).alias("steps_completed"), failure.alias("failure")))
    text = F.when(F.col("job") % 7 == 3, F.substring(doc, 1, 12)).otherwise(doc)
    path = one_file_each(e.select("job", text.alias("value")), shared_folder(spark), "text")
    read = saved(readers.read_jobs(spark, f"{path}/*/*.txt"))
    bad = readers.corrupt_jobs(read).select("path", F.lit(True).alias("bad"))
    both = read.join(bad, "path", "left")
    return both.select(number("path").alias("folder"), "job_id", "status", F.when(F.col("steps_completed").isNotNull(), F.size("steps_completed")).alias("n_steps"), F.col("failure.step").alias("failed"), F.coalesce("bad", F.lit(False)).alias("unreadable"))


@query("relation_versions", f"WITH {OVERRIDES}, v AS (SELECT 'redaction_log' AS relation, job_id, count(*) AS n FROM log WHERE job_id % 2 = 0 GROUP BY job_id UNION ALL SELECT 'matches', job_id, count(*) FROM matches GROUP BY job_id UNION ALL SELECT 'overrides', job_id, count(*) FROM (SELECT job_id FROM skips UNION ALL SELECT job_id FROM adds) GROUP BY job_id UNION ALL SELECT 'intervals', job_id, count(*) FROM merged GROUP BY job_id) SELECT * FROM v")
def relation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations written in different formats, one of them twice, and read back: the last version counts."""
    from tessera.operators import resolve as rs
    from tessera.plans.fixtures import PAD_MS

    root, m = shared_folder(spark), kept_matches(spark, sf_dir)
    o = saved(overrides_of(m))
    log = saved(rs.redaction_log(m, o, PAD_MS))
    for rows in (log, log.where("job_id % 2 = 0")):
        writers.write(rows, root, "redaction_log", fmt="json")
    writers.clean(spark, root, "redaction_log")
    writers.write(m, root, "matches", by=[])
    writers.write(o, root, "overrides", fmt="orc")
    writers.write(rs.muted_intervals(m, o, PAD_MS), root, "intervals")
    out = None
    for name in ("redaction_log", "matches", "overrides", "intervals"):
        rows = writers.read(spark, root, name).groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "job_id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("failure_log", f"SELECT user_id AS job_id, {list(STEPS)}[CAST(event_id % 12 AS INTEGER) + 1] AS step, count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY ALL")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures appended in two parts to a log that only grows."""
    root, steps = shared_folder(spark), F.array(*map(F.lit, STEPS))
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = e.select(F.col("user_id").cast("long").alias("job_id"), F.get(steps, (F.col("event_id") % 12).cast("int")).alias("step"), F.col("event_id").alias("seq"), F.lit(False).alias("done"), F.lit("stopped").alias("error"), F.lit(None).cast("string").alias("traceback"))
    for half in (0, 1):
        path = writers.append_failure(rows.where(F.col("seq") % 2 == half), root)
    return spark.read.parquet(path).groupBy("job_id", "step").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
