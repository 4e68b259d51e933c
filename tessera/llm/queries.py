"""One query for each operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, sql, toxicity
from tessera.llm.decontam import decontaminate
from tessera.llm.divergence import source_divergence
from tessera.llm.jaccard import near_duplicates
from tessera.llm.learn import remainder
from tessera.llm.linededup import drop_repeated_lines
from tessera.llm.minhash import near_duplicates_by_sketch
from tessera.llm.negatives import hard_negatives
from tessera.llm.packing import pack
from tessera.llm.secrets import KINDS, find_secrets
from tessera.llm.shared import saved, shared_folder
from tessera.llm.suffix import drop_repeats
from tessera.llm.topk import top_k
from tessera.llm.warc import assemble, read_warc, write_warc
from tessera.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def digest_decontam(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query(
    "op1_decontamination",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    lens AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
           FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
    hits AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
    pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_decontam(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def digest_secrets(found: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op4_secrets", sql.SECRETS)
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_secrets(find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def digest_captures(captures: DataFrame) -> DataFrame:
    page = F.get(F.col("metadata.fields"), 0)["page-id"].cast("long")
    pages = captures.select("capture_id", "refers_to", page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("type").alias("record_type"))
    target = pages.where("record_type = 'response'").select(F.col("capture_id").alias("key"), F.col("page_id").alias("target")).distinct()
    # a row without a reference meets its own capture, so that such rows don't share a key
    found = pages.withColumn("key", F.coalesce("refers_to", "capture_id")).join(target, "key", "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), F.col("target")).alias("refers_to"))


@query(
    "op5_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM q)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM r
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return digest_captures(assemble(saved(read_warc(spark, path, payload=False))))  # archives are read once


@query(
    "op7_line_dedup",
    r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS p, l FROM d WHERE len(l) >= 3),
    k AS (SELECT doc_id, p, array_to_string(l[p : p + 2], chr(10)) AS g FROM w),
    r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM k WHERE regexp_replace(g, '\s+', '', 'g') <> ''),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS i FROM r WHERE n > 1),
    lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY s.i) FILTER (g.i IS NULL), '') AS t
             FROM lines s LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
    """,
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query(
    "op8_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    t AS (SELECT vec_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM v),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
          FROM t a JOIN t b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
    r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
    SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
    """,
)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def language_model(docs: DataFrame) -> langid.Model:
    """Learns from the rows of documents whose crc32 modulo 4 is not 2."""
    return langid.fit(docs.where(remainder("doc_id", 4) != 2).select("text", "lang"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = langid.identify(docs, language_model(docs), keep=["doc_id"])
    return rated.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learn = remainder("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learn), labels.where(learn), label="toxic")
    return toxicity.rate(docs, model, keep=["doc_id"]).select("doc_id", (~learn).alias("held_out"), "score", "predicted")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op9_jaccard_join", sql.jaccard(5, 75))
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def digest_repeats(kept: DataFrame) -> DataFrame:
    return kept.select(
        "doc_id", (F.length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed",
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op3_suffix_dedup", sql.SUFFIX)
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_repeats(drop_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query(
    "op11_hard_negatives",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    t AS (SELECT vec_id, label, unnest(w) AS x, unnest(range(len(w))) AS i FROM v),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
          FROM t a JOIN t b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                 row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query("op12_source_divergence", sql.DIVERGENCE)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


@query("op13_minhash_dedup", sql.jaccard(2, 80, kept=True))
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_by_sketch(table(spark, sf_dir, "documents"))
