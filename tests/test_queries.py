"""Every query against DuckDB on the same tables."""

import duckdb
import pytest

from tessera.plans import QUERIES, SQL, transcript

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str(tuple(r[i] for i in at)) for r in got.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == want and want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", ["redaction_log", "merged_intervals_docs", "redaction_stats", "muted_words", "covered_share", "interval_text", "match_context", "review_replay", "all_matches_ordered", "skip_anti"])
def test_documents_are_scanned_twice_at_most(spark, name, monkeypatch):
    """Flagged once, and at most once more for what needs the words themselves."""
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("documents.parquet")
    seen, keep = [], transcript.saved
    monkeypatch.setattr(transcript, "saved", lambda df: (seen.append(scans(df)), keep(df))[1])
    seen.append(scans(QUERIES[name](spark, SF)))
    assert 1 <= sum(seen) <= 2


def test_interval_stream_has_all_sessions(spark):
    columns = ["user_id", "start_us", "end_us", "n"]
    got, want = (sorted(QUERIES[name](spark, SF).select(columns).collect()) for name in ("interval_stream", "interval_sessions"))
    assert got == want and sum(r.n for r in got) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
