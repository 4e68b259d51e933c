"""Relations derived from the given tables, in Spark and as SQL common table expressions.

Times are whole milliseconds and scores whole percents, so results compare
exactly between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import PUNCTUATION, tokens
from tessera.operators.flag import Rule, parse_lexicon, rules
from tessera.plans.registry import table
from tessera.sources.tables import spread

#: The rules that the queries use, with every notation once.
LEXICON = ["# comment line", "trash", "clown*", "*tion*", "=The", "=Of", "the", "moron*", "of the", "=And the", "idiot are the", "scum*phrase with star*", "*bad", "=", "damn!"]
PAD_MS = 500


def lexicon_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(LEXICON)], "line_no int, line string")


def lexicon_rules(spark: SparkSession) -> list[Rule]:
    return rules(parse_lexicon(lexicon_lines(spark)))


def words(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Words of documents; every 37th can't be aligned and has no times, every 41st no score.

    columns are those of the documents with a word's id. Texts meet them before they are
    split, so rows of words go through no exchange for it.
    """
    docs = table(spark, sf_dir, "documents")
    texts = spread(docs.select("doc_id", "text"), each=16 << 20, by=("doc_id",) if columns else ())
    if columns:
        texts = texts.join(docs.select("doc_id", *columns), "doc_id")
    rows = texts.select(F.col("doc_id").alias("job_id"), F.posexplode(tokens(F.col("text"))).alias("word_index", "word"), *columns)
    both = F.col("job_id") + F.col("word_index")
    timed = both % 37 != 36
    start = F.when(timed, F.col("word_index") * 400)
    score = F.when(timed & (both % 41 != 40), ((F.col("job_id") * 31 + F.col("word_index") * 17) % 101).cast("int"))
    return rows.select("job_id", "word_index", "word", start.alias("start"), (start + 300).alias("end"), score.alias("score"), *columns)


def overrides_of(matches: DataFrame) -> DataFrame:
    """Skips at flagged indices divisible by 7 and at index 1000000, which is never flagged, and an addition for every fifth job."""
    skip = matches.where("word_index % 7 = 0").select("job_id", "word_index").distinct()
    jobs = matches.select("job_id").distinct()
    skip = skip.unionByName(jobs.select("job_id", F.lit(1_000_000).alias("word_index")))
    at = (F.col("job_id") % 50) * 1000
    add = jobs.where("job_id % 5 = 0").select("job_id", F.lit("add").alias("action"), F.lit(None).cast("int").alias("word_index"), F.lit("added").alias("text"), at.cast("int").alias("start"), (at + 800).cast("int").alias("end"))
    return skip.select("job_id", F.lit("skip").alias("action"), "word_index", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")).unionByName(add)


_P = PUNCTUATION.replace("'", "''")
WORDS = rf"""
doc_tokens AS (SELECT doc_id AS job_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents),
raw_words AS (SELECT job_id, t[i + 1] AS word, CAST(i AS INTEGER) AS word_index FROM (SELECT job_id, t, unnest(range(len(t))) AS i FROM doc_tokens)),
words AS (SELECT job_id, word_index, word, trim(word, '{_P}') AS tok,
    CASE WHEN (job_id + word_index) % 37 <> 36 THEN word_index * 400 END AS st,
    CASE WHEN (job_id + word_index) % 37 <> 36 THEN word_index * 400 + 300 END AS en,
    CASE WHEN (job_id + word_index) % 37 <> 36 AND (job_id + word_index) % 41 <> 40 THEN CAST((job_id * 31 + word_index * 17) % 101 AS INTEGER) END AS score
    FROM raw_words)"""
#: kind: 1 exact, 2 exact with case, 3 starts-with, 4 contains, 5 phrase, 6 phrase with case.
LEX = """
lex(line_no, raw, kind, t1, t2, t3) AS (VALUES (2, 'trash', 1, 'trash', NULL, NULL), (3, 'clown*', 3, 'clown', NULL, NULL), (4, '*tion*', 4, 'tion', NULL, NULL),
    (5, '=The', 2, 'The', NULL, NULL), (6, '=Of', 2, 'Of', NULL, NULL), (7, 'the', 1, 'the', NULL, NULL), (8, 'moron*', 3, 'moron', NULL, NULL),
    (9, 'of the', 5, 'of', 'the', NULL), (10, '=And the', 6, 'And', 'the', NULL), (11, 'idiot are the', 5, 'idiot', 'are', 'the'),
    (12, 'scum*phrase with star*', 5, 'scum*phrase', 'with', 'star'), (15, 'damn!', 1, 'damn!', NULL, NULL))"""
MATCHES = f"""{WORDS}, {LEX},
timed AS (SELECT * FROM words WHERE st IS NOT NULL AND en IS NOT NULL AND tok <> ''),
hits AS (SELECT w.*, l.line_no, l.raw, l.kind FROM timed w JOIN lex l ON
    (l.kind = 1 AND lower(w.tok) = l.t1) OR (l.kind = 2 AND w.tok = l.t1) OR (l.kind = 3 AND starts_with(lower(w.tok), l.t1)) OR (l.kind = 4 AND contains(lower(w.tok), l.t1))),
single AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY job_id, word_index ORDER BY kind, line_no) = 1),
pairs AS (SELECT a.job_id, a.word_index, a.st, l.*, a.word AS w1, b.word AS w2, b.en AS en2, coalesce(a.score, 0) AS s1, coalesce(b.score, 0) AS s2
    FROM lex l JOIN timed a ON l.kind >= 5 AND (CASE WHEN l.kind = 6 THEN a.tok = l.t1 ELSE lower(a.tok) = l.t1 END)
    JOIN timed b ON b.job_id = a.job_id AND b.word_index = a.word_index + 1 AND (CASE WHEN l.kind = 6 THEN b.tok = l.t2 ELSE lower(b.tok) = l.t2 END)),
phrases AS (SELECT job_id, word_index, 2 AS span, w1 || ' ' || w2 AS matched_text, raw AS entry, line_no, st, en2 AS en, least(s1, s2) AS score FROM pairs WHERE t3 IS NULL
    UNION ALL SELECT p.job_id, p.word_index, 3, w1 || ' ' || w2 || ' ' || c.word, p.raw, p.line_no, p.st, c.en, least(s1, s2, coalesce(c.score, 0))
    FROM pairs p JOIN timed c ON c.job_id = p.job_id AND c.word_index = p.word_index + 2 AND lower(c.tok) = p.t3 WHERE t3 IS NOT NULL),
unranked AS (SELECT job_id, word_index, 1 AS span, word AS matched_text, raw AS entry, line_no, st, en, coalesce(score, 0) AS score FROM single UNION ALL SELECT * FROM phrases),
matches AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY word_index, span > 1, line_no) AS INTEGER) AS match_rank FROM unranked)"""
OVERRIDES = f"""{MATCHES},
jobs AS (SELECT DISTINCT job_id FROM matches),
skips AS (SELECT DISTINCT job_id, word_index FROM matches WHERE word_index % 7 = 0 UNION ALL SELECT job_id, 1000000 FROM jobs),
adds AS (SELECT job_id, 'added' AS word, CAST(job_id % 50 * 1000 AS INTEGER) AS st, CAST(job_id % 50 * 1000 + 800 AS INTEGER) AS en FROM jobs WHERE job_id % 5 = 0),
log_rows AS (SELECT m.job_id, 'matched' AS source, matched_text AS word, entry, m.word_index, st, en, score, match_rank AS seq FROM matches m
    WHERE NOT EXISTS (SELECT 1 FROM skips s WHERE s.job_id = m.job_id AND s.word_index = m.word_index)
    UNION ALL SELECT job_id, 'review_add', word, NULL, NULL, st, en, NULL, 1 FROM adds),
log AS (SELECT * EXCLUDE (seq), greatest(st - {PAD_MS}, 0) AS padded_start, en + {PAD_MS} AS padded_end,
    row_number() OVER (PARTITION BY job_id ORDER BY greatest(st - {PAD_MS}, 0), source, seq) AS log_rank FROM log_rows),
opened AS (SELECT job_id, padded_start AS s, padded_end AS e, CASE WHEN padded_start <= max(padded_end) OVER (PARTITION BY job_id ORDER BY padded_start, padded_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM log),
islands AS (SELECT *, sum(o) OVER (PARTITION BY job_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM opened),
merged AS (SELECT job_id, min(s) AS s, max(e) AS e, count(*) AS n FROM islands GROUP BY job_id, g)"""
