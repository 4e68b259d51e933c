"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tessera.llm.negatives import Asked, Search, hard_negatives, percent_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, every, scale=256, k=5, low=80, high=100):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and ok(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in rows:
        if i % every:
            continue
        scored = [(-dot(v, w), j, own) for j, w, own in rows if j != i]
        for minus, j, _ in sorted(s for s in scored if s[2] == label)[:k]:
            window = sorted(s for s in scored if s[2] != label and low * -minus <= 100 * -s[0] <= high * -minus)[:k]
            out += [(i, j, n, m, -minus, -s) for n, (s, m, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % every == 0, **options).collect())


def vectors(rng, n, width, spread=3.0):
    base = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [float(np.float32(rng.uniform(0.1, spread) * (x + rng.gauss(0, 0.4)))) for x in rng.choice(base)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rows = vectors(random.Random(seed), 400, 6)
    got = mined(spark, rows, 20)
    assert got == expected(rows, 20) and len(got) > 100


def test_odd_rows_ties_and_repeated_ids(spark):
    rng = random.Random(9)
    rows = vectors(rng, 150, 3)
    rows += [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [1.0, float("nan"), 0.0], 0), (203, [float("inf"), 0.0, 0.0], 0), (204, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(300, [], 1), (301, [2.0], 1), (302, [1.0, 1.0, 1.0, 5.0], 2)]
    rows += [(400 + i, [1.0, 0.5, 0.25], i % 2) for i in range(30)]  # ties
    rows += [(0, [1.0, 0.5, 0.25], 0), (20, [3.0, 3.0, 3.0], 1), (20, [3.0, 3.0, 3.0], 1)]  # repeated ids
    assert mined(spark, rows, 20) == expected(rows, 20)


def test_many_batches_give_the_same(spark):
    rows = vectors(random.Random(4), 300, 5)
    assert mined(spark, rows, 10, batch_bytes=6000) == mined(spark, rows, 10) == expected(rows, 10)


def test_other_windows(spark):
    rows = vectors(random.Random(5), 200, 4)
    assert mined(spark, rows, 10, positives=2, negatives=3, low=50, high=120, scale=64) == sorted(r for r in expected(rows, 10, 64, 5, 50, 120) if r[2] <= 3 and r[1] in first_positives(rows, r[0], 2))


def first_positives(rows, anchor, k):
    cut = {i: ([math.floor(64 * x) for x in v], label) for i, v, label in rows}
    own, label = cut[anchor]
    return [j for _, j in sorted((-sum(a * b for a, b in zip(own, v)), j) for j, (v, c) in cut.items() if c == label and j != anchor)[:k]]


def test_empty_tables_and_clashing_columns(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(1, [1.0], 1)], 10) == []
    rows = vectors(random.Random(6), 60, 3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as w", "1 as score", "2 as anchor", "3 as length", "4 as at", "5 as rank")
    assert sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0).collect()) == expected(rows, 10)


def test_short_buckets_are_not_scored():
    """Of buckets sorted by length those that can't reach what is needed are left out, and nothing is lost."""
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(6000, 8)) * 256 * np.geomspace(8, 0.1, 6000)[:, None]).astype(np.int64)
    ids, labels = np.arange(6000), np.zeros(6000, np.int64)
    asked = Asked(np.array([-1]), np.array([0]), rows[:1], np.full((1, 1), np.iinfo(np.int64).min), np.full((1, 1), np.iinfo(np.int64).max), True)
    search = Search(asked, 5)
    for lo in range(0, 6000, negatives.BUCKET):
        search.add(ids[lo : lo + negatives.BUCKET], labels[lo : lo + negatives.BUCKET], rows[lo : lo + negatives.BUCKET])
    assert search.scored < 4000
    want = np.lexsort((ids, -(rows @ rows[0])))[:5]
    assert sorted(search.rows()["vec_id"].tolist()) == sorted(want.tolist())


def test_percent_of():
    for score in (*range(-250, 250), 2**62 + 1, -(2**62) - 3):
        assert int(percent_of(np.int64(score), 80)) == -((-80 * score) // 100)
