"""Queries against DuckDB on the same tables, given and hand-made."""

import random

import duckdb
import pytest

from tessera.llm.jaccard import near_duplicates
from tessera.llm.queries import QUERIES, SQL, digest_repeats, digest_secrets
from tessera.llm.secrets import find_secrets
from tessera.llm.suffix import drop_repeats

SF = "/root/testdata/sf0.001"
ATOMS = ["password", "PassWD", "secret = ", "token: ", "api_key", "=", ":", " ", '"', "'", "\n", "é", "AKIA", "ABCDEFGH12345678", "abcdef", "0123456789abcdef", "x", "-", "https://", "db.example.com/a ", "s3.amazonaws.com", "client_id=", "Zz09", "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY1", " word" * 30, "_", "=="]


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def answers(con, sql, columns):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    return sorted((tuple(r[names.index(c)] for c in columns) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    columns, got = rows(QUERIES[name](spark, SF))
    assert got == answers(con, SQL[name], columns) and got


def made(spark, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    return con, spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def test_secrets_sql_on_odd_texts(spark):
    r = random.Random(12)
    docs = [(i, "".join(r.choice(ATOMS) for _ in range(r.randrange(1, 40)))) for i in range(400)] + [(900, None), (901, ""), (902, "a" * 40)]
    con, df = made(spark, docs)
    columns, got = rows(digest_secrets(find_secrets(df, keep=["doc_id"])))
    assert got == answers(con, SQL["op4_secrets"], columns)
    assert {k for row in got for s in row[columns.index("spans")].split(",") if s for k in [s.split(":")[0]]} == {"assign", "access", "hex", "ident", "key", "endpoint"}


def test_repeats_and_links_sql_on_odd_texts(spark):
    r = random.Random(13)
    base = ["".join(r.choice(["ab ", "é", "x", "the ", "\n"]) for _ in range(160)) for _ in range(6)]
    docs = [(i, (lambda t: t[r.randrange(30) :] + r.choice(["", " q", "zz " * 20]))(r.choice(base))) for i in range(80)] + [(900, None), (901, ""), (902, "a" * 3000), (903, "b" + "a" * 2500)]
    con, df = made(spark, docs)
    for name, found in (("op3_suffix_dedup", digest_repeats(drop_repeats(df, keep=["doc_id"]))), ("op9_jaccard_join", near_duplicates(df))):
        columns, got = rows(found)
        assert got == answers(con, SQL[name], columns)
