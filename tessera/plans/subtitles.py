"""Queries over subtitles, whose cues are cut from conversations and differ from what is spoken in known ways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import PUNCTUATION
from tessera.operators import flag as fl
from tessera.operators import subtitles as st
from tessera.operators.diff import sequence_diff
from tessera.plans.registry import query
from tessera.plans.transcript import SPOKEN, spoken
from tessera.sources.subtitles import read_subtitles, subtitle_block, write_subtitles
from tessera.sources.tables import saved, shared_folder

_P = PUNCTUATION.replace("'", "''")
#: Cues of six words; some are dropped, said twice, punctuated or misspelt. heard has times and scores.
CUES = rf"""{SPOKEN},
heard AS (SELECT job_id, CAST(word_index AS BIGINT) AS word_index, segment_index, pos, word, st, st + 300 AS en, CASE WHEN st IS NOT NULL THEN (job_id * 31 + word_index * 17) % 101 END AS score FROM spoken),
cut AS (SELECT job_id, segment_index, pos // 6 AS part, pos, CASE WHEN (job_id + pos) % 11 = 3 THEN NULL WHEN (job_id + pos) % 13 = 5 THEN word || ' ' || word
    WHEN (job_id + pos) % 17 = 4 THEN word || '!?' WHEN (job_id + pos) % 19 = 7 THEN left(word, length(word) - 1) || 'x' ELSE word END AS w FROM spoken),
parts AS (SELECT job_id, segment_index, part, (segment_index - 1) * 1800000 + greatest(part * 2400 - 100, 0) AS st, (segment_index - 1) * 1800000 + max(pos) * 400 + 400 AS en, coalesce(string_agg(w, ' ' ORDER BY pos), '') AS text FROM cut GROUP BY job_id, segment_index, part),
cues AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY segment_index, part) AS INTEGER) AS cue_index FROM parts)"""


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken words as a table: cues and what is done with them read it several times."""
    w = spoken(spark, sf_dir)
    return saved(w.withColumn("score", F.when(F.col("start").isNotNull(), ((F.col("job_id") * 31 + F.col("word_index") * 17) % 101).cast("int"))))


def cues(words: DataFrame) -> DataFrame:
    both = F.col("job_id") + F.col("pos")
    short = F.concat(F.left("word", F.length("word") - 1), F.lit("x"))
    w = F.when(both % 11 == 3, None).when(both % 13 == 5, F.concat_ws(" ", "word", "word")).when(both % 17 == 4, F.concat("word", F.lit("!?"))).when(both % 19 == 7, short).otherwise(F.col("word"))
    cut = words.select("job_id", "segment_index", F.floor(F.col("pos") / 6).alias("part"), "pos", w.alias("w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("pos", "w")))), lambda x: x["w"]), " ")
    own = cut.groupBy("job_id", "segment_index", "part").agg(text.alias("text"), F.max("pos").alias("last"))
    base = (F.col("segment_index") - 1) * F.lit(1_800_000)
    own = own.withColumn("start", (base + F.greatest(F.col("part") * 2400 - 100, F.lit(0))).cast("long")).withColumn("end", (base + F.col("last") * 400 + 400).cast("long"))
    return own.withColumn("cue_index", F.row_number().over(Window.partitionBy("job_id").orderBy("segment_index", "part"))).drop("last")


FILMS = 20


@query(
    "subtitle_records",
    rf"""WITH {CUES},
    films AS (SELECT job_id % {FILMS} AS film, job_id, cue_index, CAST(st + job_id // {FILMS} * 7200000 AS BIGINT) AS st, CAST(en + job_id // {FILMS} * 7200000 AS BIGINT) AS en, regexp_replace(text, '^(\S*) ', '\1' || chr(10)) AS text FROM cues)
    SELECT film AS job_id, cue_index, st AS start_ms, en AS end_ms, text, NULL AS error, NULL AS raw FROM films
    UNION ALL SELECT film, NULL, NULL, NULL, NULL, 'no line of times', 'block of ' || job_id || chr(10) || 'without times' FROM films WHERE job_id % 5 = 2 AND cue_index = 1
    UNION ALL SELECT film, NULL, NULL, NULL, NULL, 'ends before it starts', job_id || chr(10) || '00:00:09,500 --> 00:00:09,499' || chr(10) || 'backwards' FROM films WHERE job_id % 7 = 3 AND cue_index = 1""",
)
def subtitle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files with some bad blocks, written and read back."""
    later = F.floor(F.col("job_id") / FILMS) * 7_200_000
    own = cues(heard(spark, sf_dir)).withColumn("text", F.regexp_replace("text", r"^(\S*) ", "$1\n"))
    good = own.select("job_id", "cue_index", subtitle_block(F.col("cue_index"), F.col("start") + later, F.col("end") + later, F.col("text")).alias("block"))
    first = own.where("cue_index = 1")
    untimed = first.where("job_id % 5 = 2").select("job_id", F.lit(0).alias("cue_index"), F.concat(F.lit("block of "), F.col("job_id"), F.lit("\nwithout times")).alias("block"))
    wrong = first.where("job_id % 7 = 3").select("job_id", F.lit(-1).alias("cue_index"), subtitle_block(F.col("job_id"), F.lit(9500), F.lit(9499), F.lit("backwards")).alias("block"))
    path = shared_folder(spark)
    write_subtitles(good.unionByName(untimed).unionByName(wrong).withColumn("film", F.col("job_id") % FILMS), path, "film", ["job_id", "cue_index"])
    read = read_subtitles(spark, path)
    return read.select(F.col("film").cast("long").alias("job_id"), "cue_index", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text", "error", "raw")


def plain(c: str) -> Column:
    """Without characters beyond ASCII: engines differ in whether an edit is of a character or of a byte."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "e")


@query(
    "subtitle_alignment",
    rf"""WITH {CUES},
    w AS (SELECT job_id, word_index, lower(trim(regexp_replace(word, '[^\x00-\x7F]', 'e', 'g'), '{_P}')) AS a, st, en, score FROM heard WHERE st IS NOT NULL),
    c AS (SELECT job_id, cue_index, st AS cs, en AS ce, list_transform(list_filter(string_split(regexp_replace(text, '[^\x00-\x7F]', 'e', 'g'), ' '), lambda x: x <> ''), lambda x: lower(trim(x, '{_P}'))) AS t FROM cues),
    p AS (SELECT w.job_id, w.word_index, cue_index, cs, ce, list_max(list_transform(t, lambda b: CASE WHEN greatest(length(a), length(b)) > 0 THEN CAST(100 * (greatest(length(a), length(b)) - levenshtein(a, b)) // greatest(length(a), length(b)) AS INTEGER) END)) AS fuzzy
          FROM w JOIN c ON c.job_id = w.job_id AND cs <= st AND en <= ce),
    b AS (SELECT * FROM p WHERE fuzzy >= 85 QUALIFY row_number() OVER (PARTITION BY job_id, word_index ORDER BY fuzzy DESC, cs, cue_index) = 1),
    s(strategy) AS (VALUES ('whisperx_primary'), ('srt_primary'), ('highest_confidence')),
    r AS (SELECT h.job_id, h.word_index, strategy, st, en, cs, ce, cue_index, fuzzy, b.fuzzy IS NOT NULL AND (strategy = 'srt_primary' OR strategy = 'highest_confidence' AND fuzzy > coalesce(score, 0)) AS wins
          FROM heard h CROSS JOIN s LEFT JOIN b ON b.job_id = h.job_id AND b.word_index = h.word_index)
    SELECT job_id, word_index, strategy, CAST(CASE WHEN wins THEN cs ELSE st END AS BIGINT) AS start_ms, CAST(CASE WHEN wins THEN ce ELSE en END AS BIGINT) AS end_ms, CASE WHEN wins THEN 'subtitle' ELSE 'transcript' END AS timing, cue_index, fuzzy FROM r""",
)
def subtitle_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spoken word against the cues, by each of the strategies."""
    words = heard(spark, sf_dir)
    own = cues(words).withColumn("text", plain("text"))
    spans = words.select("job_id", F.col("word_index").cast("long").alias("word_index"), plain("word").alias("matched_text"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "score")
    spans = saved(spans)
    confirmed = saved(st.confirmations(spans, own))
    rows = [st.decide(spans, confirmed, strategy).withColumn("strategy", F.lit(strategy)) for strategy in st.STRATEGIES]
    return reduce(DataFrame.unionByName, rows).select("job_id", "word_index", "strategy", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "timing", "cue_index", "fuzzy")


BANNED = ("in", "the", "in the", "and", "und", "la")
REPLACED = {"and": "but", "in the": "..."}


@query(
    "subtitle_substitution",
    rf"""WITH {CUES},
    tw AS (SELECT job_id, word_index, word, st, lower(trim(word, '{_P}')) AS norm FROM heard WHERE st IS NOT NULL),
    m AS (SELECT job_id, word_index, 1 AS span, norm AS entry, CASE norm WHEN 'in' THEN 1 WHEN 'the' THEN 2 WHEN 'and' THEN 4 WHEN 'und' THEN 5 ELSE 6 END AS line_no FROM tw WHERE norm IN ('in', 'the', 'and', 'und', 'la')
          UNION ALL SELECT a.job_id, a.word_index, 2, 'in the', 3 FROM tw a JOIN tw b ON b.job_id = a.job_id AND b.word_index = a.word_index + 1 WHERE a.norm = 'in' AND b.norm = 'the'),
    f AS (SELECT job_id, word_index AS first, span, entry, line_no, unnest(range(word_index, word_index + span)) AS word_index FROM m),
    h AS (SELECT tw.job_id, tw.word_index, cue_index, norm, row_number() OVER (PARTITION BY tw.job_id, cue_index, norm ORDER BY tw.word_index) AS nth FROM tw JOIN cues c ON c.job_id = tw.job_id AND c.st <= tw.st AND tw.st < c.en),
    ct AS (SELECT job_id, cue_index, text, string_split(text, ' ') AS l FROM cues WHERE text <> ''),
    ci AS (SELECT job_id, cue_index, l, unnest(range(len(l))) AS place FROM ct),
    cw AS (SELECT job_id, cue_index, place, l[place + 1] AS w, CAST(coalesce(list_sum(list_transform(l[:place], lambda x: length(x) + 1)), 0) AS BIGINT) AS pt FROM ci),
    cn AS (SELECT job_id, cue_index, place, lower(trim(w, '{_P}')) AS norm, pt + length(w) - length(ltrim(w, '{_P}')) AS b, length(trim(w, '{_P}')) AS n FROM cw),
    s AS (SELECT *, row_number() OVER (PARTITION BY job_id, cue_index, norm ORDER BY place) AS nth FROM cn WHERE norm <> ''),
    k AS (SELECT h.job_id, h.cue_index, f.first, span, entry, line_no, place, b, b + n AS e FROM h JOIN f ON f.job_id = h.job_id AND f.word_index = h.word_index JOIN s ON s.job_id = h.job_id AND s.cue_index = h.cue_index AND s.norm = h.norm AND s.nth = h.nth),
    g AS (SELECT *, place - row_number() OVER (PARTITION BY job_id, cue_index, first, span, line_no ORDER BY place) AS run FROM k),
    r AS (SELECT job_id, cue_index, line_no, min(b) AS b, max(e) AS e, any_value(CASE entry WHEN 'and' THEN 'but' WHEN 'in the' THEN '...' ELSE '[censored]' END) AS put FROM g GROUP BY job_id, cue_index, first, span, line_no, run),
    o AS (SELECT *, CASE WHEN b < max(e) OVER (PARTITION BY job_id, cue_index ORDER BY b, e DESC, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM r),
    i AS (SELECT *, sum(o) OVER (PARTITION BY job_id, cue_index ORDER BY b, e DESC, line_no ROWS UNBOUNDED PRECEDING) AS i FROM o),
    u AS (SELECT job_id, cue_index, min(b) AS b, max(e) AS e, arg_min(put, (b, -e, line_no)) AS put FROM i GROUP BY job_id, cue_index, i),
    z AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY job_id, cue_index ORDER BY b), 0) AS z FROM u),
    x AS (SELECT z.job_id, z.cue_index, string_agg(substr(text, z + 1, b - z) || put, '' ORDER BY b) || substr(any_value(text), max(e) + 1) AS text, count(*) AS n FROM z JOIN ct USING (job_id, cue_index) GROUP BY z.job_id, z.cue_index)
    SELECT c.job_id, c.cue_index, coalesce(x.text, c.text) AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_replaced FROM cues c LEFT JOIN x ON x.job_id = c.job_id AND x.cue_index = c.cue_index""",
)
def subtitle_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = heard(spark, sf_dir)
    rules = [fl.Rule(x, tuple(x.split()), "exact", False, i) for i, x in enumerate(BANNED, 1)]
    other = spark.createDataFrame(list(REPLACED.items()), "entry string, replacement string")
    out = st.substitute(cues(words), words, fl.flag(words, rules), substitutions=F.broadcast(other))
    return out.select("job_id", "cue_index", "text", "n_replaced")


@query(
    "subtitle_differences",
    rf"""WITH RECURSIVE {CUES},
    aw AS (SELECT job_id, word_index + 1 AS i, lower(trim(word, '{_P}')) AS x FROM heard),
    bw AS (SELECT job_id, cue_index, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM cues),
    bi AS (SELECT job_id, cue_index, unnest(range(len(w))) AS k, lower(trim(unnest(w), '{_P}')) AS y FROM bw),
    b AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY cue_index, k) AS j, y FROM bi UNION ALL SELECT DISTINCT job_id, 0, NULL FROM bi),
    r(job_id, i, j, y, v) AS (SELECT job_id, 0::BIGINT, j, y, 0::BIGINT FROM b UNION ALL
        SELECT job_id, i + 1, j, y, max(c) OVER (PARTITION BY job_id ORDER BY j) FROM (
            SELECT r.job_id, r.i, r.j, r.y, CASE WHEN r.y = aw.x THEN lag(r.v) OVER (PARTITION BY r.job_id ORDER BY r.j) + 1 ELSE r.v END AS c FROM r JOIN aw ON aw.job_id = r.job_id AND aw.i = r.i + 1)),
    n AS (SELECT job_id, max(i) AS n FROM aw GROUP BY job_id),
    m AS (SELECT job_id, max(j) AS m FROM b GROUP BY job_id)
    SELECT job_id, CAST(n AS BIGINT) AS n_spoken, CAST(m AS BIGINT) AS n_shown, CAST(v AS BIGINT) AS n_equal, CAST(n + m - 2 * v AS BIGINT) AS cost FROM r JOIN n USING (job_id) JOIN m USING (job_id) WHERE i = n AND j = m""",
)
def subtitle_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far cues and spoken words of a conversation are apart: the script itself isn't unique, its cost is."""
    words = heard(spark, sf_dir)
    spoken_ = words.select("job_id", F.col("word_index").alias("at"), st.normal(F.col("word")).alias("token"))
    script = sequence_diff(spoken_, st.shown_words(cues(words)).select("job_id", "at", "token"))
    a, b = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    return script.groupBy("job_id").agg(F.sum(a).alias("n_spoken"), F.sum(b).alias("n_shown"), F.sum(F.when(F.col("op") == "equal", a).otherwise(0)).alias("n_equal"), F.sum(F.when(F.col("op") == "equal", 0).otherwise(a + b)).alias("cost"))
