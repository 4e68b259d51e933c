"""A corpus pipeline of five stages over documents.

Each stage takes all that the one before it kept and returns the columns of
documents, written as Parquet and read again; the last returns one row for
each piece of a text and the bin that it is packed into.

Rows with a null or empty text are rejected by the first stage; a later stage
that meets them keeps them as they are, and packing gives them no piece. Rows
that repeat a document whole count as that document and stay or go together.
Rows that repeat an id with another text are judged by their own text, and what
one loses leaves the others as they are. A row with a null id counts as having no id: it is not removed as a duplicate. Ties
in the similarity of copies don't matter, as the smallest id of a group stays.
Columns other than those of documents are left out, whatever their names. Texts
of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.decontam import decontaminate
from tessera.llm.jaccard import near_duplicates
from tessera.llm.linededup import drop_repeated_lines
from tessera.llm.packing import pack
from tessera.llm.queries import language_model
from tessera.llm.shared import hint, saved, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough certainty; lang becomes that language."""
    rated = langid.identify(docs.select(*COLUMNS), language_model(docs))
    return rated.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the three-line passages of earlier documents; what has nothing left goes."""
    kept = drop_repeated_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows go by their id and text."""
    marked = docs.select(*COLUMNS).withColumn("__digest", F.md5("text"))
    doomed = saved(near_duplicates(marked, carry=("__digest",)).where("component_id <> doc_id").select("doc_id", "__digest").distinct())
    return marked.join(hint(doomed, 1_000_000), ["doc_id", "__digest"], "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs.select(*COLUMNS), benchmark).where(F.size("hit_items") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's pieces and the bins that they are packed into."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_known_languages),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, similarity components and packing are not for SQL: tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
