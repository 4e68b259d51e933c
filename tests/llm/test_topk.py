import math
import random

from pyspark.sql import functions as F

from tessera.llm.topk import top_k


def brute(rows, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, **more).collect())


def test_matches_brute_force_with_ties_and_odd_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(5)]) for i in range(300)]
    rows += [(400, None), (401, [None, 1.0]), (420, [float("nan")]), (440, [float("inf")]), (460, []), (480, [3.0]), (500, [1.0] * 9), (None, [1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, batch_bytes=2000) == brute(rows)


def test_repeated_rows_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])]
    assert sorted(r[2] for r in run(spark, rows)) == [1, 1, 1, 1]
    assert run(spark, rows[:0]) == []
    big = [(0, [1e6] * 3), (20, [-1e6] * 3), (3, [1.0] * 3)]
    assert run(spark, big) == brute(big)


def test_any_column_names_and_no_queries(spark):
    rows = [(i, [float(i % 7), 1.0, -0.5], 1, 2, 3, 4) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, w int, q int, score int, rank int")
    for more in ({}, {"batch_bytes": 900}):
        assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, **more).collect()) == brute([r[:2] for r in rows])
    assert top_k(df, F.col("vec_id") < 0).collect() == []


def test_more_queries_than_a_tile(spark, monkeypatch):
    from tessera.llm import topk

    monkeypatch.setattr(topk, "TILE", 2)
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_ids_that_are_no_numbers_take_no_part(spark):
    df = spark.createDataFrame([("0", [1.0], True), ("x", [2.0], True), ("7", [0.5], False)], "vec_id string, embedding array<float>, asked boolean")
    assert sorted(tuple(r) for r in top_k(df, F.col("asked")).collect()) == [(0, 1, 7, 2048)]
