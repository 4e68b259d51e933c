"""Formats, names, codecs, configuration, job state, audio and progress, over rows derived from the given tables and a few edge cases beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import config, media
from tessera.functions import text as tx
from tessera.operators import audio, jobs
from tessera.operators import resolve as rs
from tessera.plans.fixtures import OVERRIDES, WORDS, words
from tessera.plans.registry import query, table
from tessera.plans.transcript import muted, turns
from tessera.sources import readers
from tessera.streaming.progress import progress, session_intervals


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else ("TRUE" if x else "FALSE") if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


STREAMS = [("AAC", "LC", "128000", 2, "stereo"), ("ac3", None, "N/A", 6, None), ("dts", "DTS-HD MA", "900000", 8, "7.1"), ("dts", "DTS", None, 6, "unknown"), ("truehd", "", None, 8, ""), ("mlp", None, "500000", 2, None), ("weird", None, "700000", 4, "Unknown"), ("flac", None, "9", 1, "mono"), ("pcm_s24le", None, None, 2, None), ("opus", None, "0", 3, None), (None, None, "12.5", 2, "quad"), ("vorbis", None, "80000", 1, "unknown")]
#: What orders stand for: each is a track with a codec, a profile, a bit rate and a layout.
CODECS = ("aac", "AC3", "eac3", "dts", "DTS", "mp3", "flac", "truehd", "mlp", "vorbis", "opus", "wmav2", "pcm_s24le", "alac", "")
PROFILES, LAYOUT_NAMES = ("LC", "DTS-HD MA", "DTS", "", "main"), ("stereo", "unknown", "", "5.1(side)", "Unknown", "quad")
_TRACK = f"""SELECT o_orderkey AS id, {list(CODECS)}[o_orderkey % {len(CODECS)} + 1] AS codec, CASE WHEN o_custkey % 6 < 5 THEN {list(PROFILES)}[o_custkey % 6 + 1] END AS profile,
    CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey * 997 AS VARCHAR) WHEN 1 THEN 'N/A' WHEN 2 THEN o_custkey || '.5' END AS rate, CAST(o_custkey % 9 AS INTEGER) AS channels, CASE WHEN o_orderkey % 7 < 6 THEN {list(LAYOUT_NAMES)}[o_orderkey % 7 + 1] END AS layout FROM orders"""
_S = f"""streams AS (SELECT -row_number() OVER () AS id, * FROM (SELECT * FROM {values(STREAMS)} AS t(codec, profile, rate, channels, layout)) UNION ALL {_TRACK})"""


def one_of(names: tuple[str, ...], i: Column) -> Column:
    """names[i], null beyond the last."""
    return F.get(F.array(*map(F.lit, names)), i)


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = literal(spark, [(-i, *x) for i, x in enumerate(STREAMS, 1)], "id long, codec string, profile string, rate string, channels int, layout string")
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rate = F.when(key % 4 == 0, (cust * 997).cast("string")).when(key % 4 == 1, "N/A").when(key % 4 == 2, F.concat(cust.cast("string"), F.lit(".5")))
    own = o.select(key.cast("long").alias("id"), one_of(CODECS, (key % len(CODECS)).cast("int")).alias("codec"), one_of(PROFILES, (cust % 6).cast("int")).alias("profile"), rate.alias("rate"), (cust % 9).cast("int").alias("channels"), one_of(LAYOUT_NAMES, (key % 7).cast("int")).alias("layout"))
    return edge.unionByName(own)


_CASES = lambda table_, key: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in table_.items()) + " END"


@query(
    "encoder_choice",
    f"""WITH {_S},
    a AS (SELECT *, lower(coalesce(nullif(codec, ''), 'unknown')) AS c, coalesce(profile, '') AS p, CASE WHEN regexp_matches(rate, '^[0-9]+$') THEN nullif(CAST(rate AS BIGINT), 0) END AS r FROM streams),
    b AS (SELECT *, {_CASES(media.ENCODERS, "c")} AS e, c IN ('truehd', 'mlp') OR (c = 'dts' AND contains(lower(p), 'ma')) AS bad FROM a)
    SELECT id, codec, profile, rate, CASE WHEN bad OR e IS NULL THEN 'ac3' ELSE e END AS encoder,
        CAST(CASE WHEN bad OR e IS NULL THEN least(coalesce(r, 640000), 640000) WHEN e IN ('flac', 'pcm_s16le') THEN 0 ELSE coalesce(r, {_CASES(media.BIT_RATES, "e")}, 192000) END AS BIGINT) AS bitrate,
        CASE WHEN bad THEN c || CASE WHEN p <> '' THEN ' (' || p || ')' ELSE '' END || ': no lossless encoder' WHEN e IS NULL THEN c || ': unknown codec' END AS reason FROM b""",
)
def encoder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir).withColumn("x", media.choose_encoder(F.col("codec"), F.col("profile"), F.col("rate"))).select("id", "codec", "profile", "rate", "x.*")


@query("layout_default", f"WITH {_S} SELECT id, codec, channels, layout, coalesce(CASE WHEN lower(layout) NOT IN ('', 'unknown') THEN layout END, CASE channels WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' END, 'stereo') AS chosen, coalesce({_CASES(media.EXTENSIONS, 'codec')}, '.' || codec) AS extension FROM streams")
def layout_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir).select("id", "codec", "channels", "layout", media.channel_layout(F.col("layout"), F.col("channels")).alias("chosen"), media.raw_extension(F.col("codec")).alias("extension"))


@query("safe_int", f"WITH {_S} SELECT DISTINCT rate, CASE WHEN regexp_matches(rate, '^[0-9]+$') THEN CAST(rate AS BIGINT) END AS n FROM streams")
def safe_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir).select("rate", tx.safe_int(F.col("rate")).alias("n")).distinct()


NAMES = ["The Long Way Down.mkv", "Harbour Lights- A Winter Story (2031).1080p.hevc.mkv", "plain", "a.b.c.mp4", "Two (1999) Years (2001).mkv", "x" * 40 + ".avi", "--- odd --- name that is long enough to be cut.mkv", "$dollar (1986) \\ back.mkv", "(12345) none.mkv", "ÉTÉ à la mer.mkv"]
_N = rf"""names AS (SELECT * FROM {values([(n,) for n in NAMES])} AS t(name) UNION ALL SELECT trim(left(regexp_replace(text, '\s+', ' ', 'g'), CAST(20 + doc_id % 40 AS INTEGER))) ||
    CASE doc_id % 5 WHEN 0 THEN '.mkv' WHEN 1 THEN ' (' || (1900 + doc_id % 130) || ').1080p.mkv' WHEN 2 THEN '' WHEN 3 THEN ' (12345) ' || doc_id || '.mp4' ELSE ' (2001) $1 (1999).avi' END FROM documents WHERE text IS NOT NULL)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names: edge cases, and the beginnings of documents with years and extensions."""
    d, i = table(spark, sf_dir, "documents").where("text is not null"), F.col("doc_id")
    end = F.when(i % 5 == 0, ".mkv").when(i % 5 == 1, F.concat(F.lit(" ("), (i % 130 + 1900).cast("string"), F.lit(").1080p.mkv"))).when(i % 5 == 2, "").when(i % 5 == 3, F.concat(F.lit(" (12345) "), i.cast("string"), F.lit(".mp4"))).otherwise(" (2001) $1 (1999).avi")
    own = d.select(F.concat(F.trim(F.left(F.regexp_replace("text", r"\s+", " "), (i % 40 + 20).cast("int"))), end).alias("name"))
    return literal(spark, [(x,) for x in NAMES], "name string").unionByName(own)
_STEM = r"regexp_replace(name, '^(.+)\.[^.]*$', '\1')"


@query(
    "output_names",
    rf"""WITH {_N}, s AS (SELECT name, {_STEM} AS stem FROM names)
    SELECT name, CASE WHEN regexp_matches(stem, '\(\d{{4}}\)') THEN regexp_replace(stem, '^(.*?\(\d{{4}}\))', '\1 {{edition-Clean}}') ELSE stem || ' {{edition-Clean}}' END || '.mkv' AS edition, stem || '_clean.mp4' AS suffixed FROM s""",
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("name", tx.output_name(F.col("name")).alias("edition"), tx.output_name(F.col("name"), "suffix", "_clean", "mp4").alias("suffixed"))


@query(
    "slugs",
    rf"""WITH {_N}, w AS (SELECT name, trim(regexp_replace(lower({_STEM}), '[^a-z0-9]+', '-', 'g'), '-') AS w FROM names)
    SELECT name, CASE WHEN length(w) > 32 THEN rtrim(regexp_replace(w[:33], '-[^-]*$', ''), '-') ELSE w END AS slug,
        '20260616_131611_' || CASE WHEN length(w) > 32 THEN rtrim(regexp_replace(w[:33], '-[^-]*$', ''), '-') ELSE w END || '_' || sha256(name || ':1.5')[:8] AS folder FROM w""",
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("name", tx.slug(F.col("name")).alias("slug"), tx.job_folder(F.lit("20260616_131611"), F.col("name"), tx.job_id(F.col("name"), F.lit("1.5"))).alias("folder"))


@query("job_ids", "SELECT page_id, sha256(url || ':' || CAST(page_id AS VARCHAR) || '.25')[:12] AS job_id FROM pages")
def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.job_id(F.col("url"), F.concat(F.col("page_id").cast("string"), F.lit(".25"))).alias("job_id"))


SECONDS = [(0.0,), (90.0,), (3661.0,), (7389.9,), (59.96,), (0.25,), (0.35,), (400000.0,), (1203.14,)]


@query(
    "durations_fmt",
    f"""WITH v(s) AS (SELECT * FROM {values(SECONDS)} UNION ALL SELECT n_chars * (1 + doc_id % 300) / 16.0::DOUBLE FROM documents), i AS (SELECT s, CAST(floor(s) AS BIGINT) AS n, CAST(round_even(s * 10, 0) AS BIGINT) AS d FROM v)
    SELECT CAST(s AS DOUBLE) AS s, printf('%02d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) AS hms, printf('%02d:%02d:%02d.%d', d // 36000, d % 36000 // 600, d % 600 // 10, d % 10) AS tenths FROM i""",
)
def durations_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select((F.col("n_chars") * (F.col("doc_id") % 300 + 1) / 16.0).alias("s"))
    return literal(spark, SECONDS, "s double").unionByName(own).select("s", tx.duration(F.col("s")).alias("hms"), tx.clock_tenths(F.col("s")).alias("tenths"))


TIMES = [("1203.14",), ("12:30",), ("01:02:03.5",), (" 7 ",), ("",), ("abc",), ("1:2:3:4",), ("nan",), ("inf",), ("1_0",), ("1:",), (":5",), (".5",), ("5.",), (None,), ("..",), ("1.2.3",)]


@query(
    "times_parse",
    rf"""WITH v(t) AS (SELECT * FROM {values(TIMES)} UNION ALL SELECT CASE event_id % 6 WHEN 0 THEN event_id || '.' || event_id % 10 WHEN 1 THEN event_id % 100 || ':' || event_id % 60 WHEN 2 THEN event_id % 30 || ':' || event_id % 60 || ':' || event_id % 60 || '.5'
        WHEN 3 THEN '  ' || user_id || ' ' WHEN 4 THEN event_type ELSE event_id || ':' || user_id || ':1:2' END FROM events), p AS (SELECT t, string_split(trim(t), ':') AS a FROM v), n AS (SELECT t, len(a) AS k, list_transform(a, lambda x: CASE WHEN regexp_matches(x, '^([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN CAST(x AS DOUBLE) END) AS a FROM p)
    SELECT t, CASE WHEN k = 1 THEN a[1] WHEN k = 2 THEN a[1] * 60 + a[2] WHEN k = 3 THEN a[1] * 3600 + a[2] * 60 + a[3] END AS seconds FROM n""",
)
def times_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    own = F.when(k % 6 == 0, F.concat_ws(".", k, k % 10)).when(k % 6 == 1, F.concat_ws(":", k % 100, k % 60)).when(k % 6 == 2, F.concat(F.concat_ws(":", k % 30, k % 60, k % 60), F.lit(".5"))).when(k % 6 == 3, F.concat(F.lit("  "), u.cast("string"), F.lit(" "))).when(k % 6 == 4, F.col("event_type")).otherwise(F.concat_ws(":", k, u, F.lit("1:2")))
    return literal(spark, TIMES, "t string").unionByName(e.select(own.alias("t"))).select("t", tx.parse_time(F.col("t")).alias("seconds"))


SIZES = [(0,), (312,), (1023,), (1024,), (471859200,), (1288490189,), (5497558138880,), (1048524,)]


@query(
    "size_fmt",
    f"""WITH v(n) AS (SELECT * FROM {values(SIZES)} UNION ALL SELECT (o_orderkey * 64 + o_custkey % 3) * [1, 1024, 1048576, 1073741824][o_custkey % 4 + 1] FROM orders) SELECT CAST(n AS BIGINT) AS n, CASE WHEN n < 1024 THEN printf('%.0f B', CAST(n AS DOUBLE)) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0)
    WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0) ELSE printf('%.1f TB', n / 1099511627776.0) END AS shown FROM v""",
)
def size_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(1024**i).cast("long") for i in range(4)]), (F.col("o_custkey") % 4).cast("int"))
    own = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") * 64 + F.col("o_custkey") % 3) * unit).cast("long").alias("n"))
    return literal(spark, SIZES, "n long").unionByName(own).select("n", tx.size(F.col("n")).alias("shown"))


OFFSETS = [("-0700",), ("+05:30",), ("",), (None,), ("UTC",), (" +0100 ",), ("+1",)]
_O = rf"""o(raw) AS {values(OFFSETS)}, p AS (SELECT raw, regexp_matches(trim(coalesce(raw, '')), '^[+-]\d\d:?\d\d$') AS ok FROM o),
    z AS (SELECT raw, ok, CASE WHEN ok THEN regexp_replace(trim(raw), '^([+-]\d\d):?(\d\d)$', '\1:\2') ELSE '+00:00' END AS zone FROM p)"""


_OWN = "CASE WHEN event_id % 11 = 10 THEN NULL WHEN event_id % 11 = 9 THEN event_type ELSE CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(event_id % 15 AS VARCHAR), CASE WHEN event_id % 11 = 8 THEN 3 ELSE 2 END, '0') || CASE WHEN event_id % 3 = 0 THEN ':' ELSE '' END || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') END"


@query("tz_offsets", f"WITH {_O.replace(values(OFFSETS), f'(SELECT * FROM {values(OFFSETS)} UNION ALL SELECT {_OWN} FROM events)')} SELECT raw, zone AS \"offset\", ok AS explicit FROM z")
def tz_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    hours = F.when(k % 11 == 8, F.lpad((k % 15).cast("string"), 3, "0")).otherwise(F.lpad((k % 15).cast("string"), 2, "0"))
    raw = F.concat(F.when(F.col("user_id") % 2 == 0, "+").otherwise("-"), hours, F.when(k % 3 == 0, ":").otherwise(""), F.lpad((k % 60).cast("string"), 2, "0"))
    own = table(spark, sf_dir, "events").select(F.when(k % 11 == 10, None).when(k % 11 == 9, F.col("event_type")).otherwise(raw).alias("raw"))
    return literal(spark, OFFSETS, "raw string").unionByName(own).select("raw", tx.utc_offset(F.col("raw")).alias("x")).select("raw", "x.*")


@query(
    "wall_clock",
    f"""WITH {_O}, e AS (SELECT event_id, raw, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, zone FROM events, z WHERE raw IN ('-0700', '+05:30'))
    SELECT event_id, raw, strftime(make_timestamp((s + (CASE WHEN zone[1] = '-' THEN -60 ELSE 60 END) * (CAST(zone[2:3] AS INTEGER) * 60 + CAST(zone[5:6] AS INTEGER))) * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || replace(zone, ':', '') AS local, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS utc FROM e""",
)
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = F.broadcast(literal(spark, [x for x in OFFSETS if x[0] in ("-0700", "+05:30")], "raw string"))
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s")).crossJoin(zones)  # two literal rows
    return e.select("event_id", "raw", tx.wall_clock(F.col("s"), tx.utc_offset(F.col("raw"))["offset"]).alias("x")).select("event_id", "raw", "x.*")


@query("iso_epochs", "SELECT event_id, epoch_us(ts) AS us FROM events")
def iso_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return table(spark, sf_dir, "events").select("event_id", tx.iso_epoch(iso).alias("us"))


SETTINGS = [("log_level", "DEBUG", "INFO", "WARN"), ("log_level", None, "INFO", "WARN"), ("size", None, None, "1800"), ("none", None, None, None)]


@query("config_resolve", f"WITH v(name, env, file, fallback) AS (SELECT * FROM {values(SETTINGS)} UNION ALL SELECT c_name, CASE WHEN c_custkey % 3 = 0 THEN 'env' || c_custkey END, CASE WHEN c_custkey % 5 < 2 THEN 'file' || c_nationkey END, nullif(c_mktsegment, 'FURNITURE') FROM customer) SELECT name, env, coalesce(env, file, fallback) AS value FROM v")
def config_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("env"), k.cast("string"))).alias("env"), F.when(k % 5 < 2, F.concat(F.lit("file"), F.col("c_nationkey").cast("string"))).alias("file"), F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("fallback"))
    v = literal(spark, SETTINGS, "name string, env string, file string, fallback string").unionByName(own)
    return v.select("name", "env", config.setting(F.col("env"), F.col("file"), F.col("fallback")).alias("value"))


KEEP = [(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False)]


@query("retention", f"WITH v(a, b, c, n) AS (SELECT *, 1 FROM {values(KEEP)} UNION ALL SELECT [TRUE, FALSE, NULL][c_custkey % 3 + 1], [TRUE, FALSE, NULL][c_nationkey % 3 + 1], c_acctbal > 0, 1 FROM customer) SELECT a, b, c, count(*) AS n, coalesce(a, FALSE) OR (c AND coalesce(b, TRUE)) AS kept FROM v GROUP BY ALL")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = lambda c: F.get(F.array(F.lit(True), F.lit(False), F.lit(None)), (F.col(c) % 3).cast("int"))
    own = table(spark, sf_dir, "customer").select(three("c_custkey").alias("a"), three("c_nationkey").alias("b"), (F.col("c_acctbal") > 0).alias("c"))
    every = literal(spark, KEEP, "a boolean, b boolean, c boolean").unionByName(own)
    return every.withColumn("kept", config.keeps(F.col("a"), F.col("b"), F.col("c"))).groupBy("a", "b", "c", "kept").agg(F.count("*").alias("n"))


EVENTS = [(j, s, n, d) for j in (1, 2, 3) for n, (s, d) in enumerate([(s, True) for s in jobs.STEPS[: 12 if j < 3 else 6]] + ([("5_mute", False)] if j == 2 else []))]
_E = f"e AS (SELECT * FROM {values(EVENTS)} AS t(job_id, step, seq, done) UNION ALL SELECT user_id + 10, {list(jobs.STEPS)}[CAST(event_id * 7 % 12 AS INTEGER) + 1], event_id, event_type <> 'error' FROM events), done AS (SELECT job_id, step FROM e GROUP BY ALL HAVING arg_max(done, seq))"


def done_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a job, each event the end of a step; errors undo it."""
    own = table(spark, sf_dir, "events").select((F.col("user_id") + 10).cast("long").alias("job_id"), one_of(jobs.STEPS, (F.col("event_id") * 7 % 12).cast("int")).alias("step"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") != "error").alias("done"))
    return jobs.completed(literal(spark, EVENTS, "job_id long, step string, seq long, done boolean").unionByName(own))


def some_jobs(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select((F.col("user_id") + 10).cast("long").alias("job_id")).distinct()
    return ids.unionByName(literal(spark, [(1,), (2,), (3,), (4,)], "job_id long")).where(where)


@query("job_state_latest", f"WITH {_E} SELECT * FROM done")
def job_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return done_steps(spark, sf_dir)


@query("redo_invalidation", f"WITH {_E} SELECT * FROM done WHERE job_id % 2 = 0 OR step NOT IN {jobs.CORRECTED}")
def redo_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.invalidate(done_steps(spark, sf_dir), some_jobs(spark, sf_dir, "job_id % 2 <> 0"))


@query("redo_steps", f"WITH {_E} SELECT * FROM done WHERE NOT (job_id % 4 = 1 AND step IN ('4b_flag', '7_mux'))")
def redo_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.redo(done_steps(spark, sf_dir), some_jobs(spark, sf_dir, "job_id % 4 = 1").withColumn("step", F.explode(F.array(F.lit("4b_flag"), F.lit("7_mux")))))


_STEPS = values([(i, s) for i, s in enumerate(jobs.STEPS)])


@query("next_steps", f"WITH {_E}, s(n, step) AS {_STEPS}, j AS (SELECT DISTINCT user_id + 10 AS job_id FROM events UNION ALL VALUES (1), (2), (3), (4)), t AS (SELECT j.job_id, s.n, s.step FROM j, s WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.job_id = j.job_id AND (d.step = s.step OR (d.step = '3b_merge' AND s.n <= 5)))) SELECT j.job_id, (SELECT arg_min(step, n) FROM t WHERE t.job_id = j.job_id) AS step FROM j")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.next_step(done_steps(spark, sf_dir), some_jobs(spark, sf_dir, "true"))


_BARS = ["0%| ", " 50%|#", "100%|##", "100%|##", "0%|", "  7%|", "100%|", "100%|", "0%|", "0%|", "100%|", "0%|", "99%|", "100%|", "100%|"]
LINES = [(1, 0, "out", "Selected model is a bag of 4 models. You will see 4 progress bars.")] + [(1, i + 1, "err", x) for i, x in enumerate(_BARS)] + [(2, i, "err", x) for i, x in enumerate(["note", *_BARS[:6]])]


@query(
    "progress_fold",
    rf"""WITH RECURSIVE l AS (SELECT * FROM {values(LINES)} AS t(job_id, seq, stream, line) UNION ALL SELECT user_id + 10, CAST(i AS INTEGER), CASE WHEN bag THEN 'out' ELSE 'err' END, CASE WHEN bag THEN 'a bag of ' || (1 + event_id % 4) || ' models' ELSE ' ' || (event_id * 25 % 125) || '%|##' END
        FROM (SELECT *, i = 0 AND user_id % 3 <> 0 AS bag FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events))),
    f AS (SELECT job_id, seq, CASE WHEN stream = 'out' THEN TRY_CAST(regexp_extract(line, 'bag of (\d+) models', 1) AS INTEGER) END AS bag, CASE WHEN stream = 'err' THEN TRY_CAST(regexp_extract(line, '^\s*(\d{{1,3}})%\|', 1) AS INTEGER) END AS pct FROM l),
    r AS (SELECT job_id, CAST(-1 AS INTEGER) AS seq, CAST(1 AS INTEGER) AS n, CAST(0 AS INTEGER) AS i, CAST(0 AS INTEGER) AS p, FALSE AS saw FROM (SELECT DISTINCT job_id FROM l)
        UNION ALL SELECT f.job_id, f.seq, coalesce(bag, n), CASE WHEN pct = 0 AND saw THEN least(i + 1, n - 1) ELSE i END, CASE WHEN pct = 0 AND saw THEN 0 ELSE coalesce(pct, p) END, CASE WHEN pct = 0 AND saw THEN FALSE ELSE saw OR coalesce(pct = 100, FALSE) END
        FROM r JOIN f ON f.job_id = r.job_id AND f.seq = r.seq + 1)
    SELECT job_id, seq, n AS n_models, i AS model_index, p AS last_pct, least(1.0::DOUBLE, (i + p / 100.0::DOUBLE) / n) AS fraction, least(i + 1, n) || '/' || n AS label FROM r WHERE seq >= 0""",
)
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    bag = (F.col("seq") == 0) & (F.col("user_id") % 3 != 0)  # a tool names its models once, before it begins
    line = F.when(bag, F.concat(F.lit("a bag of "), (k % 4 + 1).cast("string"), F.lit(" models"))).otherwise(F.concat(F.lit(" "), (k * 25 % 125).cast("string"), F.lit("%|##")))
    own = e.withColumn("seq", seq).select((F.col("user_id") + 10).cast("long").alias("job_id"), "seq", F.when(bag, "out").otherwise("err").alias("stream"), line.alias("line"))
    return progress(literal(spark, LINES, "job_id long, seq int, stream string, line string").unionByName(own))


_NTH = "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id * 7919 % 2001 - 1000 AS s"


@query("mix_samples", f"WITH a AS (SELECT user_id AS job_id, {_NTH} FROM events), b AS (SELECT user_id AS job_id, {_NTH} FROM events WHERE event_id % 3 <> 0) SELECT CAST(a.job_id AS BIGINT) AS job_id, a.i, a.s + coalesce(b.s, 0) AS sample FROM a LEFT JOIN b ON a.job_id = b.job_id AND a.i = b.i")
def mix_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track of each user's events, and a shorter one of two thirds of them."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    track = lambda e: e.select(F.col("user_id").cast("long").alias("job_id"), nth.alias("i"), (F.col("event_id") * 7919 % 2001 - 1000).alias("sample"))
    e = table(spark, sf_dir, "events")
    return audio.mix(track(e), track(e.where("event_id % 3 <> 0")))


@query("mute_samples", """WITH b AS (SELECT doc_id, unnest(range(10 + n_chars % 300)) AS i, doc_id % 7 AS a, doc_id % 7 + n_chars % 20 + 0.5 AS e, 30 + doc_id % 3 AS a2 FROM documents)
    SELECT doc_id AS id, CAST(sum(CASE WHEN i BETWEEN a * 8 AND e * 8 OR i BETWEEN a2 * 8 AND a2 * 8 THEN 0 ELSE i % 100 + 1 END) AS BIGINT) AS total, count_if(i BETWEEN a * 8 AND e * 8 OR i BETWEEN a2 * 8 AND a2 * 8) AS muted FROM b GROUP BY doc_id""")
def mute_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of samples for each document, muted in two intervals."""
    d, n = F.col("doc_id"), F.col("n_chars")
    samples = F.transform(F.sequence(F.lit(0), (n % 300 + 9).cast("int")), lambda i: i % 100 + 1)
    span = lambda a, e: F.struct(a.cast("double").alias("start"), e.cast("double").alias("end"))
    spans = F.array(span(d % 7, d % 7 + n % 20 + 0.5), span(d % 3 + 30, d % 3 + 30))
    quiet = table(spark, sf_dir, "documents").select(d.alias("id"), audio.mute_block(samples, F.lit(0), 8000, spans).alias("s"))
    return quiet.select("id", F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"), F.size(F.filter("s", lambda x: x == 0)).cast("long").alias("muted"))


@query("eta_estimates", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_quantity > 0 AND l_discount > 0 THEN greatest(0, l_extendedprice - l_quantity * 1000) * l_discount / (l_quantity * 1000) END AS DOUBLE) AS remaining FROM lineitem")
def eta_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = media.eta(F.col("l_quantity") * 1000, F.col("l_extendedprice"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", left.alias("remaining"))


@query(
    "interval_text",
    f"""WITH {OVERRIDES} SELECT job_id, string_agg(printf('between(t,%.4f,%.4f)', s / 1000, e / 1000), '+' ORDER BY s, e) AS expression FROM merged GROUP BY job_id""",
)
def interval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = muted(spark, sf_dir).select("job_id", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    return m.groupBy("job_id").agg(tx.interval_expression(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("expression"))


@query(
    "covered_share",
    f"""WITH {OVERRIDES}, h AS (SELECT w.job_id, w.word_index FROM words w SEMI JOIN merged g ON g.job_id = w.job_id AND w.st BETWEEN g.s AND g.e)
    SELECT w.job_id, count(*) AS n, count(h.word_index) AS muted FROM words w LEFT JOIN h ON h.job_id = w.job_id AND h.word_index = w.word_index GROUP BY w.job_id""",
)
def covered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rs.mark_covered(words(spark, sf_dir), muted(spark, sf_dir), 60_000)
    return marked.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if("covered").alias("muted"))


def separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).cast("int").alias("segment_index"), F.coalesce("text", F.lit("")).cast("binary").alias("audio"))
    return audio.separate(s, audio.SilentSeparator)


@query("backend_separate", "SELECT conv_id AS job_id, CAST(turn + 1 AS INTEGER) AS segment_index, sha256(coalesce(text, '')) AS dialogue_sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS background_bytes, TRUE AS silent FROM conversations")
def backend_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    silent = F.regexp_replace(F.hex("background"), "0", "") == ""
    return separated(spark, sf_dir).select("job_id", "segment_index", F.sha2("dialogue", 256).alias("dialogue_sha256"), F.octet_length("background").cast("long").alias("background_bytes"), silent.alias("silent"))


@query(
    "backend_transcribe",
    r"""WITH t AS (SELECT conv_id AS job_id, CAST(turn + 1 AS INTEGER) AS segment_index, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations),
    e AS (SELECT job_id, segment_index, w, CAST(unnest(range(len(w))) AS INTEGER) AS pos FROM t)
    SELECT job_id, segment_index, pos, w[pos + 1] AS word, pos * 0.4::DOUBLE AS "start", pos * 0.4::DOUBLE + 0.3::DOUBLE AS "end", 0.9::DOUBLE AS score FROM e""",
)
def backend_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.transcribe(separated(spark, sf_dir), audio.TextTranscriber)


_TRACKS = "t AS (SELECT conv_id AS job_id, turn, 3 + (conv_id + turn) % 4 AS n FROM conversations)"


@query(
    "pcm_concat",
    f"WITH {_TRACKS}, b AS (SELECT *, coalesce(CAST(sum(n) OVER (PARTITION BY job_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS at_ FROM t), s AS (SELECT *, unnest(range(n)) AS i FROM b) SELECT job_id, at_ + i AS i, CAST((turn * 100 + i) % 30000 AS SMALLINT) AS sample FROM s",
)
def pcm_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.lit(3) + (F.col("job_id") + F.col("turn")) % 4).cast("int")
    samples = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((F.col("turn") * 100 + i) % 30_000).cast("smallint"))
    blocks = turns(spark, sf_dir).select("job_id", "segment_index", F.lit(0).alias("block"), samples.alias("samples"))
    return audio.concatenate(blocks).select("job_id", "at", F.posexplode("samples").alias("p", "sample")).select("job_id", (F.col("at") + F.col("p")).alias("i"), "sample")


@query(
    "downmix_samples",
    """WITH f AS (SELECT doc_id, k, doc_id * 50 + k AS i FROM (SELECT doc_id, unnest(range(1 + n_chars % 50)) AS k FROM documents)),
    s AS (SELECT doc_id, k, CAST(i * 37 % 20000 - 10000 AS DOUBLE) AS a, CAST(i * 53 % 20000 - 10000 AS DOUBLE) AS b, CAST(i * 71 % 20000 - 10000 AS DOUBLE) AS c, CAST(i * 89 % 20000 - 10000 AS DOUBLE) AS r, CAST(i * 97 % 20000 - 10000 AS DOUBLE) AS q FROM f),
    w AS (SELECT 1 / (1 + 2 * sqrt(0.5::DOUBLE)) AS m, sqrt(0.5::DOUBLE) / (1 + 2 * sqrt(0.5::DOUBLE)) AS h)
    SELECT doc_id, k, CAST(round(a * m + c * h + r * h) AS SMALLINT) AS l6, CAST(round(b * m + c * h + q * h) AS SMALLINT) AS r6, CAST(a AS SMALLINT) AS l1, CAST(a AS SMALLINT) AS r1 FROM s, w""",
)
def downmix_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six channels and one of waves that begin at each document's number."""
    wave = lambda i, k: (i * k % 20_000 - 10_000).cast("int")
    last = (F.col("n_chars") % 50).cast("long")
    frames = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.col("doc_id") * 50 + k)
    six = F.flatten(F.transform(frames, lambda i: F.array(wave(i, 37), wave(i, 53), wave(i, 71), F.lit(9999), wave(i, 89), wave(i, 97))))
    both = table(spark, sf_dir, "documents").select("doc_id", last.alias("last"), audio.downmix_block(six, 6).alias("x"), audio.downmix_block(F.transform(frames, lambda i: wave(i, 37)), 1).alias("y"))
    side = lambda c, s: F.get(c, (F.col("k") * 2 + s).cast("int"))
    return both.select("doc_id", "x", "y", F.explode(F.expr("sequence(0L, last)")).alias("k")).select("doc_id", "k", side("x", 0).alias("l6"), side("x", 1).alias("r6"), side("y", 0).alias("l1"), side("y", 1).alias("r1"))


PROBES = ['{"streams":[{"codec_name":"aac","channels":2,"channel_layout":"stereo","duration":"12.5","tags":{"DELAY":"3"}},{"codec_name":"ac3"}],"format":{"duration":"99"}}', '{"streams":[{"codec_name":"dts","channels":6}],"format":{"duration":"7.25"}}', '{"streams":[{"codec_name":"pcm_s16le"}],"format":{}}', '{"streams":[],"format":{"duration":"1"}}']


@query(
    "probe_streams",
    f"""WITH v(doc) AS (SELECT * FROM {values([(p,) for p in PROBES])} UNION ALL SELECT '{{"streams":[{{"codec_name":"' || codec || '"' || CASE WHEN id % 3 = 0 THEN ',"duration":"' || id || '.5"' ELSE '' END || ',"channels":' || channels || CASE WHEN id % 5 = 0 THEN ',"tags":{{"DELAY":"' || channels || '"}}' ELSE '' END || '}},{{"codec_name":"ac3"}}],"format":{{' || CASE WHEN id % 4 < 3 THEN '"duration":"' || id || '"' ELSE '' END || '}}}}' FROM ({_TRACK})) SELECT doc, json_extract_string(doc, '$.streams[0].codec_name') AS codec, CAST(json_extract_string(doc, '$.streams[0].channels') AS INTEGER) AS channels, json_extract_string(doc, '$.streams[0].tags.DELAY') AS delay,
    CAST(coalesce(json_extract_string(doc, '$.streams[0].duration'), json_extract_string(doc, '$.format.duration')) AS DOUBLE) AS duration_sec FROM v""",
)
def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, i, text = streams(spark, sf_dir).where("id >= 0"), F.col("id"), lambda c: F.col(c).cast("string")
    doc = F.concat(
        F.lit('{"streams":[{"codec_name":"'), "codec", F.lit('"'), F.when(i % 3 == 0, F.concat(F.lit(',"duration":"'), text("id"), F.lit('.5"'))).otherwise(""), F.lit(',"channels":'), text("channels"),
        F.when(i % 5 == 0, F.concat(F.lit(',"tags":{"DELAY":"'), text("channels"), F.lit('"}'))).otherwise(""), F.lit('},{"codec_name":"ac3"}],"format":{'), F.when(i % 4 < 3, F.concat(F.lit('"duration":"'), text("id"), F.lit('"'))).otherwise(""), F.lit("}}"),
    )
    rows = readers.read_probe(literal(spark, [(p,) for p in PROBES], "doc string").unionByName(own.select(doc.alias("doc"))), "doc")
    return rows.select("doc", F.col("stream.codec_name").alias("codec"), F.col("stream.channels").alias("channels"), F.try_element_at("stream.tags", F.lit("DELAY")).alias("delay"), "duration_sec")


_PRESENT = [(j, o) for j in (1, 2, 3) for _, o, _ in jobs.OUTPUTS if not (j == 1 and o in ("dialog.wav", "review.json")) and not (j == 2 and o in ("dialog.wav", "censor_log.json"))]


@query("steps_to_run", f"WITH {_E}, s(n, step) AS {_STEPS}, j AS (SELECT DISTINCT user_id + 10 AS job_id FROM events UNION ALL VALUES (1), (2), (3), (4)), d AS (SELECT * FROM done WHERE step NOT IN ('1a_extract', '2_separate')) SELECT j.job_id, CAST(s.n AS INTEGER) AS n, s.step FROM j, s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.job_id = j.job_id AND (d.step = s.step OR (d.step = '3b_merge' AND s.n <= 5)))")
def steps_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of the block are not known to be done; jobs whose block has ended skip them all the same."""
    known = done_steps(spark, sf_dir).where(~F.col("step").isin("1a_extract", "2_separate"))
    return jobs.steps_to_run(known, some_jobs(spark, sf_dir, "true"))


@query(
    "missing_outputs",
    f"""WITH {_E}, o(step, output, until) AS {values(list(jobs.OUTPUTS))}, p AS (SELECT * FROM {values(_PRESENT)} AS t(job_id, output) UNION ALL SELECT d.job_id, o.output FROM done d JOIN o ON o.step = d.step WHERE d.job_id >= 10 AND (d.job_id + length(o.output)) % 3 <> 0)
    SELECT d.job_id, d.step, o.output FROM done d JOIN o ON o.step = d.step WHERE NOT EXISTS (SELECT 1 FROM done u WHERE u.job_id = d.job_id AND u.step = o.until) AND NOT EXISTS (SELECT 1 FROM p WHERE p.job_id = d.job_id AND p.output = o.output)""",
)
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = done_steps(spark, sf_dir)
    outputs = literal(spark, list(jobs.OUTPUTS), "step string, output string, until string").select("step", "output")
    own = done.where("job_id >= 10").join(F.broadcast(outputs), "step").where((F.col("job_id") + F.length("output")) % 3 != 0).select("job_id", "output")
    return jobs.missing_outputs(done, literal(spark, _PRESENT, "job_id long, output string").unionByName(own))


@query("reviewed_steps", f"WITH {_E} SELECT * FROM done WHERE job_id % 5 <> 3 OR step NOT IN {jobs.CORRECTED} UNION SELECT user_id + 10, '4b_review' FROM events WHERE (user_id + 10) % 5 = 3 UNION SELECT 3, '4b_review'")
def reviewed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reviewed(done_steps(spark, sf_dir), some_jobs(spark, sf_dir, "job_id % 5 = 3"))


@query(
    "encoded_tracks",
    f"""WITH {_S}, n AS (SELECT id, rate, channels, layout FROM streams WHERE id >= 0 AND codec = 'alac'),
    r AS (SELECT id, least(coalesce(CASE WHEN regexp_matches(rate, '^[0-9]+$') THEN nullif(CAST(rate AS BIGINT), 0) END, 640000), 640000) AS b, coalesce(CASE WHEN lower(layout) NOT IN ('', 'unknown') THEN layout END, CASE channels WHEN 0 THEN 'stereo' WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' END, 'stereo') AS l FROM n)
    SELECT id AS job_id, 'ac3' AS encoder, b AS bitrate, CAST(strlen('ac3 ' || b || ' ' || l || chr(10)) + strlen(CAST(id AS VARCHAR)) AS BIGINT) AS n_bytes FROM r""",
)
def encoded_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of a codec without an encoder, handed to a stand-in for the tool."""
    tracks = streams(spark, sf_dir).where("id >= 0 and codec = 'alac'").select(F.col("id").alias("job_id"), F.col("id").cast("string").cast("binary").alias("audio"), F.col("codec").alias("codec_name"), "profile", F.col("rate").alias("bit_rate"), "channels", F.col("layout").alias("channel_layout"))
    return audio.encode(tracks, audio.PlainEncoder).select("job_id", "encoder", "bitrate", F.octet_length("encoded").cast("long").alias("n_bytes"))


_SESSIONS = """WITH i AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 20 MINUTES THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM i)
    SELECT user_id, epoch_us(min(ts)) - 600000000 AS start_us, epoch_us(max(ts)) + 600000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, g.g"""


def _micros(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("interval_sessions", _SESSIONS)
def interval_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _micros(session_intervals(e, "user_id", "ts", 600))


@query(
    "phrase_context_rule",
    f"""WITH {WORDS}, n AS (SELECT *, max(CASE WHEN lower(tok) = 'not' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY word_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS near FROM words)
    SELECT job_id, count(*) AS n FROM n WHERE lower(tok) = 'the' AND coalesce(near, 0) = 0 GROUP BY job_id""",
)
def phrase_context_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words flagged unless one of the three words before them is `not`-like: an extra rule form."""
    from tessera.functions.text import strip_punctuation

    by = Window.partitionBy("job_id").orderBy("word_index").rowsBetween(-3, -1)
    w = words(spark, sf_dir).withColumn("low", F.lower(strip_punctuation(F.col("word"))))
    return w.withColumn("near", F.max(F.when(F.col("low") == "not", 1).otherwise(0)).over(by)).where("low = 'the' and coalesce(near, 0) = 0").groupBy("job_id").agg(F.count("*").alias("n"))
