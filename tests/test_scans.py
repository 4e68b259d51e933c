"""Two-level scans, as-of joins, densities, grains, top rows, changes and sketches against plain loops; one key may hold everything."""

import bisect
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import relations as rl
from tessera.operators import sketches as sk
from tessera.operators.scan import RANGE, Ordered, as_of_join, density, interval_union
from tessera.plans import fixtures, scans


def rows_of(seed, one_key, n=600):
    r = random.Random(seed)
    return [(7 if one_key else r.choice([None, 1, 2, 3, *range(10, 60)]), i, r.choice([None, *range(-50, 50)])) for i in r.sample(range(5000), n)]


@pytest.mark.parametrize("one_key", [True, False])
@pytest.mark.parametrize("descending", [False, True])
def test_scans_equal_a_loop(spark, one_key, descending):
    rows = rows_of(1, one_key)
    own = Ordered.of(spark.createDataFrame(rows, "k int, o int, v int"), ["k"], ["o"], descending=descending, parts=13)
    share = [r["count"] for r in own.rows.groupBy(RANGE).count().collect()]
    assert len(share) > 8 and max(share) < len(rows) / 4  # no range holds more than its share
    for kind in ("max", "min", "sum", "last"):
        for before in (False, True):
            got = {(r.k, r.o): r.x for r in own.scan("x", kind, F.col("v"), before=before).rows.collect()}
            by = defaultdict(list)
            for k, o, v in sorted(rows, key=lambda x: x[1], reverse=descending):
                seen = [x for x in by[k] if x is not None] + ([] if before or v is None else [v])
                want = {"max": max, "min": min, "sum": sum, "last": lambda s: s[-1]}[kind](seen) if seen else None
                assert got[k, o] == want, (kind, before, k, o)
                by[k].append(v)


@pytest.mark.parametrize("one_key", [True, False])
def test_interval_union(spark, one_key):
    r = random.Random(3)
    rows = [(1 if one_key else r.randrange(20), s, s + r.randrange(0, 40)) for s in (r.randrange(20_000) for _ in range(900))] + [(1, 5, 9_000)] * (not one_key) + [(2, None, 4), (2, 9, None)]
    got = sorted(tuple(x) for x in interval_union(spark.createDataFrame(rows, "k int, start long, end long"), ["k"], parts=9).collect())
    want = []
    for k, s, e in sorted(x for x in rows if None not in x):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((k, s, e, 1))
    assert got == sorted(want) and len(want) > 50
    assert interval_union(spark.createDataFrame([], "k int, start long, end long"), ["k"]).collect() == []


@pytest.mark.parametrize("one_key", [True, False])
def test_as_of_join(spark, one_key):
    r = random.Random(5)
    left = [(1 if one_key else r.choice([None, 1, 2, 3]), r.choice([None, *range(300)]), i) for i in range(400)]
    right = [(1 if one_key else r.choice([None, 1, 2, 4]), r.choice([None, *range(300)]), i, r.choice([None, "a", "b"])) for i in range(150)]
    a, b = spark.createDataFrame(left, "k int, t long, id int"), spark.createDataFrame(right, "k int, u long, n int, s string")
    got = sorted((tuple(x) for x in as_of_join(a, b, ["k"], "t", "u", ["n"], parts=7).select("k", "t", "id", "u", "n", "s").collect()), key=str)
    want = []
    for k, t, i in left:
        found = max(((u, n, s) for q, u, n, s in right if q == k and u is not None and t is not None and u <= t), key=lambda x: x[:2], default=(None, None, None))
        want.append((k, t, i, *found))
    assert got == sorted(want, key=str) and sum(x[3] is None for x in want) > 0
    with pytest.raises(ValueError):
        as_of_join(a, b.withColumnRenamed("n", "id"), ["k"], "t", "u", [])
    assert as_of_join(a, b.limit(0), ["k"], "t", "u", []).where("n is not null").isEmpty() and as_of_join(a.limit(0), b, ["k"], "t", "u", []).isEmpty()


@pytest.mark.parametrize("width", [0, 10, 100_000])
def test_density(spark, width):
    r = random.Random(8)
    rows = [(r.choice([1, 1, 1, None, 2]), r.choice([None, *range(0, 900, 3)])) for _ in range(500)]
    got = sorted((tuple(x) for x in density(spark.createDataFrame(rows, "k int, t int"), ["k"], "t", width, parts=6).collect()), key=str)
    by = defaultdict(list)
    for k, t in rows:
        if t is not None:
            by[k].append(t)
    want = []
    for k, ts in by.items():
        ts.sort()
        want += [(k, t, ts.count(t), bisect.bisect_right(ts, t) - bisect.bisect_left(ts, t - width)) for t in set(ts)]
    assert got == sorted(want, key=str)


def test_grains_are_one_exchange(spark):
    rows = [("a", "x", 1), ("a", None, 2), (None, "x", 3), ("b", "x", 4), ("a", "x", 5)]
    out = rl.grains(spark.createDataFrame(rows, "g string, h string, v int"), [["g", "h"], ["g"], []], n=F.count("*"), total=F.sum("v"))
    assert sorted((tuple(r) for r in out.select("g", "h", "grain", "n", "total").collect()), key=str) == sorted([("a", "x", 0, 2, 6), ("a", None, 0, 1, 2), (None, "x", 0, 1, 3), ("b", "x", 0, 1, 4), ("a", None, 1, 3, 8), (None, None, 1, 1, 3), ("b", None, 1, 1, 4), (None, None, 3, 5, 15)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Expand") == 1


@pytest.mark.parametrize("salts", [1, 32])
def test_best_rows(spark, salts):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 5 + ["b", None]), r.choice([None, *range(20)]), f"t{i}") for i in range(900)] + [("few", 1, "only")]
    got = sorted((tuple(x) for x in rl.best(spark.createDataFrame(rows, "g string, n int, t string"), ["g"], "n", ["t"], 7, salts).collect()), key=str)
    by = defaultdict(list)
    for g, n, t in rows:
        by[g].append((n is None, -(n or 0), t, n))
    assert got == sorted(((g, n, t, i) for g, own in by.items() for i, (_, _, t, n) in enumerate(sorted(own)[:7], 1)), key=str)


def test_changes_round_trip(spark):
    r = random.Random(11)
    draw = lambda n: [(r.choice([None, 1, 2]), r.choice([None, "a", "b", "c"])) for _ in range(n)]
    for old, new in [(draw(80), draw(90)), ([], draw(5)), (draw(5), []), (draw(30),) * 2]:
        a, b = (spark.createDataFrame(x, "i int, s string") for x in (old, new))
        feed = rl.changes(a, b)
        want = {k: Counter(new)[k] - Counter(old)[k] for k in {*old, *new}}
        assert {(x.i, x.s): x.change for x in feed.collect()} == {k: n for k, n in want.items() if n}
        assert Counter(tuple(x) for x in rl.apply_changes(a, feed).collect()) == Counter(new)
        assert {(x.i, x.s): x.n for x in rl.unchanged(a, b).collect()} == dict(Counter(old) & Counter(new))
    with pytest.raises(Exception, match="not there"):
        rl.apply_changes(a, spark.createDataFrame([(5, "z", -1)], "i int, s string, change long")).collect()


def test_sketches_merge_and_err_little(spark):
    r = random.Random(6)
    rows = [(day, group, r.randrange(4000), r.gauss(0, 1)) for day in range(6) for group in ("a", "b") for _ in range(4000)] + [(9, "nulls", None, None)]
    df = spark.createDataFrame(rows, "day int, g string, x int, v double").repartition(5)
    stored = sk.sketch(df, ["day", "g"], "x", "v")
    merged, once = ({x.g: x for x in sk.estimates(s).collect()} for s in (sk.merge(stored, ["g"]), sk.sketch(df, ["g"], "x", "v")))
    for g in ("a", "b"):
        xs, vs = {x for _, k, x, _ in rows if k == g}, sorted(v for _, k, _, v in rows if k == g)
        for found in (merged[g], once[g]):
            assert found.rows == len(vs) and abs(found.distinct_estimate - len(xs)) < 0.05 * len(xs)
            for q, value in ((0.5, found.q50), (0.9, found.q90), (0.99, found.q99)):
                assert abs(bisect.bisect(vs, value) / len(vs) - q) < 0.03
        assert merged[g].distinct_estimate == once[g].distinct_estimate  # registers are maxima, so merging loses nothing
    assert (merged["nulls"].rows, merged["nulls"].distinct_estimate, merged["nulls"].q50) == (1, 0, None)


def test_words_meet_columns_of_documents_before_texts_are_split(spark, tmp_path):
    rows = [(1, "a b, c", "en", "x"), (1, "d", None, "y"), (2, "e e", "de", None), (3, None, "en", "x"), (None, "f", "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id as job_id", "lang", "source")
    got, want = fixtures.words(spark, str(tmp_path), "lang", "source"), fixtures.words(spark, str(tmp_path)).join(docs, "job_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 10


@pytest.mark.parametrize("name", ["sketched_scores", "top_terms"])
def test_rows_of_words_are_not_joined(spark, name, monkeypatch):
    seen, keep = [], scans.saved
    monkeypatch.setattr(scans, "saved", lambda df: (seen.append(df), keep(df))[1])
    last = getattr(scans, name)(spark, "/root/testdata/sf0.001")
    plan = (seen or [last])[0]._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate posexplode") < plan.index("Join Inner")
