import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.jaccard import near_duplicate_links, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def shingles(t, k=5):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def edit(r, words, rate):
    return [r.choice("pqrs") + str(r.randrange(99)) if r.random() < rate else w for w in words]


def cases(seed, groups=25):
    r, docs = random.Random(seed), []
    passage = [f"s{i}" for i in range(30)]
    for _ in range(groups):
        base = [r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randrange(1, 120))]
        for _ in range(r.randrange(1, 9)):
            w = edit(r, base, r.choice([0, 0.01, 0.03, 0.05, 0.1]))
            w = w + passage if r.random() < 0.5 else w[: len(w) - r.randrange(0, 4)] or w
            docs.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    r.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", (100, 3, 8)[seed - 1])
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", (1 << 20, 2000, 9000)[seed - 1])
    monkeypatch.setattr(jaccard, "FEW", (200_000, 0, 5)[seed - 1])
    docs = cases(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = near_duplicates(df, least_frequent=(64, 3, 6)[seed - 1], most_frequent=(10**6, 10**6, 20)[seed - 1], split=(20_000, 5, 8)[seed - 1])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)


def test_odd_texts_repeated_rows_and_one_large_group(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(edit(r, base, 0.02))) for i in range(200)] + [(1000 + i, "same old text of six words") for i in range(200)]
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "ONE"), (505, "one two"), (None, "one two"), (506, "a " * 5000), (507, "A " * 4000), (508, "x" * 200_000 + " b c d e"), (509, "X" * 200_000 + " b c d e"), (3, "another text with the same id"), (3, "another text with the same id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert sorted((tuple(x) for x in near_duplicates(df).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("rate", [0.02, 0.05, 0.1])
def test_large_group_of_near_copies(spark, rate, monkeypatch):
    """Some of them similar, many not quite: their lists are hot."""
    monkeypatch.setattr(jaccard, "HOT", 20)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    r = random.Random(int(rate * 100))
    base = [f"w{i}" for i in range(90)]
    docs = [(i, " ".join(edit(r, base, rate)[: r.randrange(60, 91)])) for i in range(250)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in near_duplicates(df, least_frequent=4, split=40).collect()), key=str) == brute(docs)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", 3), (2, "a b", 4)], "doc_id long, text string, node int")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_links_match_brute_force(spark):
    """Every link, also within a large group, where components need only some."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = cases(4) + [(1000 + i, " ".join(edit(r, base, 0.02))) for i in range(80)] + [(2000, None), (2001, ""), (None, "one two"), (2002, "ONE two")]
    least = {}
    for d, t in docs:
        if s := frozenset(shingles(t)):
            least[s] = min((x for x in (d, least.get(s)) if x is not None), default=None)
    sets = list(least)
    want = sorted(tuple(sorted((least[a], least[b]))) for i, a in enumerate(sets) for b in sets[:i] if 100 * len(a & b) >= 75 * len(a | b))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for more in ({}, {"least_frequent": 3, "most_frequent": 20}):
        assert sorted(tuple(x) for x in near_duplicate_links(df, **more).collect()) == want and len(want) > 200


def test_long_lists_are_dealt_out(spark, monkeypatch):
    """Workers get the bound as an argument: parts of lists and their leaders are there, and change nothing."""
    seen, links = [], jaccard._entries
    monkeypatch.setattr(jaccard, "_entries", lambda found, roots: (seen.append({r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}), links(found, roots))[1])
    r = random.Random(31)
    base, common = [f"w{i}" for i in range(40)], [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(edit(r, base, 0.03))) for i in range(60)] + [(100 + i, " ".join([f"x{i}y{j}" for j in range(30)] + common[: 20 + i % 40])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = near_duplicates(df, least_frequent=3, split=10, range_tokens=300)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(docs)
    assert seen[0].get(3, 0) > 10
    links_of = lambda **more: sorted(tuple(x) for x in near_duplicate_links(df, least_frequent=3, **more).collect())
    assert links_of(split=10, range_tokens=300) == links_of() != []


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (5, "a b", "y"), (5, "c", "z"), (6, None, "n")], "doc_id long, text string, mark string")
    assert sorted(tuple(r) for r in near_duplicates(df, carry=("mark",)).collect()) == [(1, 1, 1, "x"), (5, 1, 1, "y"), (5, 1, 5, "z"), (6, 0, 6, "n")]


def test_tables_beyond_the_bound_are_not_broadcast(spark, tmp_path):
    """A table is small on disk long after it is too large for a driver; Spark alone looks at its files."""
    from tessera.llm.shared import small

    spark.range(2000).selectExpr("id % 7 AS node", "1 AS x").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda limit: spark.range(10).withColumnRenamed("id", "node").join(small(table, 64, limit), "node", "left")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(1 << 20) and "Broadcast" not in plan(1 << 10)
    assert "Broadcast" not in spark.range(10).withColumnRenamed("id", "node").join(small(table, F.lit(64), 1 << 10).select("node"), "node", "left_anti")._jdf.queryExecution().executedPlan().toString()
