"""The session stream: late rows, bounded state, restarts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import sessions as ss
from tessera.streaming.sessions import merged, run_sessions, session_rows

GAP, DELAY = 60, 300


def events(seed, keys, n=400):
    r = random.Random(seed)
    out = []
    for part in range(3):
        for _ in range(n):
            t = (part * 2000 + r.randrange(2000)) * 1_000_000 + r.randrange(1_000_000)
            late = r.random() < 0.15
            out.append((part + late, r.choice(keys), t))
    return [[(k, t) for p, k, t in out if p == part] for part in range(4)]


def expected(parts):
    mark, late, kept = 0, [], {}
    for rows in parts:
        for k, t in rows:
            if t // 10**6 * 10**6 < mark * 1000:
                late.append((k, t))
            else:
                kept.setdefault(k, []).append((t, t, 1))
        mark = max([mark, *(t // 1000 - DELAY * 1000 for _, t in rows)])
    return sorted((k, *s) for k, rows in kept.items() for s in merged(rows, GAP * 10**6)), sorted(late), mark


def land(spark, folder, rows):
    at = F.timestamp_micros("t").alias("ts")
    spark.createDataFrame(rows, "user long, t long").select("user", at).coalesce(2).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("user long, ts timestamp").parquet(f"{folder}/in")


def result(spark, folder):
    rows = session_rows(spark, folder).collect()
    late = sorted((r.key, r.first, r.last, r.n) for r in rows if r.kind == "late")
    return sorted((r.key, r.first, r.last, r.n) for r in rows if r.kind != "late"), late, [r for r in rows if r.kind == "open"]


@pytest.mark.parametrize("keys", [[1, 2, 3, 4, 5, 6, 7], [5]])
def test_late_rows_are_counted_and_state_holds_open_sessions_only(spark, tmp_path, keys):
    parts = events(len(keys), keys)
    for rows in parts:
        run_sessions(land(spark, tmp_path, rows), "user", "ts", GAP, DELAY, f"file://{tmp_path}")
    got, late, open_ = result(spark, f"file://{tmp_path}")
    want, want_late, mark = expected(parts)
    assert got == want and len(want_late) > 50
    assert sum(x[3] for x in late) == len(want_late) and {x[0] for x in late} == {k for k, _ in want_late}
    # nothing stays that the watermark has passed
    assert open_ and all((r.last + GAP * 10**6) // 1000 + 1000 > mark for r in open_)


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    parts = events(9, [1, 2, 3])
    failed = []

    def fail(batch, number):
        if not failed:
            failed.append(number)
            raise RuntimeError("lost after its rows were written")

    for i, rows in enumerate(parts):
        stream = land(spark, tmp_path, rows)
        if i == 2:
            with pytest.raises(Exception, match="lost after"):
                run_sessions(stream, "user", "ts", GAP, DELAY, f"file://{tmp_path}", fail)
        run_sessions(stream, "user", "ts", GAP, DELAY, f"file://{tmp_path}")
    got, late, _ = result(spark, f"file://{tmp_path}")
    want, want_late, _ = expected(parts)
    assert failed and got == want and sum(x[3] for x in late) == len(want_late)


def test_rows_without_key_or_time_and_settings(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run_sessions(land(spark, tmp_path, [(None, 5), (1, None), (1, 7), (1, 7)]), "user", "ts", GAP, DELAY, f"file://{tmp_path}")
    assert result(spark, f"file://{tmp_path}")[0] == [(1, 7, 7, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_rows_of_a_second_are_one():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"key": k, "at": t} for k, t in [(1, 999_999), (1, 5), (1, 1_000_000), (2, 7), (1, 6)]])
    rows = [r for b in ss._by_second(iter([batch])) for r in b.to_pylist()]
    assert sorted(tuple(r.values()) for r in rows) == [(1, 5, 999_999, 3), (1, 1_000_000, 1_000_000, 1), (2, 7, 7, 1)]


class Handle:
    """What a key's sessions ask of Spark, counted."""

    def __init__(self):
        self.held, self.timers, self.calls = [], set(), 0

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Now:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


@pytest.mark.parametrize("seed", range(5))
def test_a_key_has_one_timer_however_many_sessions(seed):
    r, handle, mark, want, got, fired = random.Random(seed), Handle(), 0, [], [], 0
    one = ss.Sessions(GAP * 10**6)
    one.init(handle)

    def fire():
        nonlocal fired
        while due := sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(due[0])
            fired += 1
            got.extend(x for b in one.handleExpiredTimer((1,), Now(mark), None) for x in b[["first", "last", "n"]].itertuples(index=False, name=None))

    for part in range(4):
        times = [mark * 1000 + r.randrange(8_000) * 10**6 for _ in range(60)]
        want += times
        list(one.handleInputRows((1,), iter([pd.DataFrame({"first": times, "last": times, "n": 1})]), Now(mark)))
        mark = max(mark, max(want) // 1000 - DELAY * 1000)
        fire()
    mark = max(want) // 1000 + 10**9
    fire()
    assert sorted(map(tuple, got)) == merged([(t, t, 1) for t in want], GAP * 10**6) and not handle.held
    assert handle.calls <= 2 * 4 + 2 + fired and len(got) > 5 * fired
