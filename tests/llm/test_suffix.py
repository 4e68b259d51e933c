import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix
from tessera.llm.queries import digest_repeats
from tessera.llm.suffix import drop_repeats, maximal_repeats


def brute(docs, span=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one 50-byte string at a time."""
    last, least, out = 2**63, {}, []
    raw = [(last if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            least[w] = min(least.get(w, i), i)
    for (i, b), (d, _) in zip(raw, docs, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - span + 1):
            if least[b[p : p + span]] < i:
                gone[p : p + span] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice(["ab", "ü", " the", "x.", "\n", "é!"]) for _ in range(n))
    shared = [say(n) for n in (24, 26, 30, 60, 200)]
    docs = []
    for i in range(60):
        parts = [r.choice(shared)[r.randrange(0, 9) :] if r.random() < 0.5 else say(r.randrange(1, 60)) for _ in range(r.randrange(1, 7))]
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[i % 7][1]) for i in range(20)]
    r.shuffle(docs)
    return docs


def run(spark, docs, parts=5, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((tuple(x) for x in digest_repeats(drop_repeats(df, keep=["doc_id"], **more)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    docs = cases(seed)
    assert run(spark, docs, parts=seed * 2, range_bytes=(1 << 20, 300, 5000)[seed - 1], broadcast_bytes=(1 << 20, 0, 0)[seed - 1], span_bytes=(1 << 20, 0, 0)[seed - 1]) == brute(docs)


def test_odd_texts_and_repeated_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    docs = [(1, "a" * 2000), (2, "a" * 1500 + long), (3, long), (3, long), (3, "b" + long), (None, long), (None, long), (4, None), (5, ""), (6, "a" * 49), (7, "a" * 50), (8, "xy" * 700), (9, "yx" * 700), (-5, "é" * 60), (10, "é" * 60)]
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs[:0]) == []


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 300)
    r = random.Random(6)
    docs = [(i, "".join(r.choice(["ab", "cd ", "e"]) for _ in range(700))) for i in range(3)]
    docs += [(9, docs[0][1][100:900] + docs[2][1][:1000])]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([0] * len(docs)), pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["__id", "__row", "__at", "__text"])
    order = [("part", "ascending"), ("r", "ascending")]
    typed = pa.schema([("part", pa.int32()), ("r", pa.int32()), ("blob", pa.binary())])
    table = lambda rows: iter(pa.Table.from_batches([pa.RecordBatch.from_pydict(d).cast(typed) for d in rows]).sort_by(order).to_batches())
    keys = {}
    for d in suffix._gather(table(suffix._shared(3)(table(suffix._anchors(50, 3, 3, "__text")(iter([batch])))))):
        keys |= dict(zip((int(i) for i in d["__at"]), d["keys"], strict=True))
    batch = batch.append_column("keys", pa.array([keys.get(i, b"") for i, _ in docs], pa.binary()))
    sent = [pa.RecordBatch.from_pydict(d) for d in suffix._spread(50, 4, 2, "__text")(iter([batch]))]
    table = pa.Table.from_batches([b.cast(pa.schema([("part", pa.int32()), ("r", pa.int32()), ("blob", pa.binary())])) for b in sent]).sort_by([("part", "ascending"), ("r", "ascending")])
    found = pa.Table.from_batches([pa.RecordBatch.from_pydict(d) for d in suffix._find(50, 2)(iter(table.to_batches()))]).sort_by([("part", "ascending"), ("r", "ascending")])
    spans = {}
    for d in suffix._merge(iter(found.to_batches())):
        spans |= {int(i): np.frombuffer(b, np.int64).reshape(2, -1) for i, b in zip(d["__id"], d["spans"], strict=True)}
    for i, _, removed, n, _ in brute(docs):
        a = spans.get(i, np.zeros((2, 0), int))
        assert (int((a[1] - a[0]).sum()), a.shape[1]) == (removed, n)


def test_interval_tree_gives_all_maximal_repeats():
    r = random.Random(5)
    for _ in range(40):
        text = bytes(r.choice(b"ab") for _ in range(40))
        at = np.arange(len(text))
        before = np.array([-1, *text[:-1]])
        got = {(n, tuple(sorted(some.tolist()))) for n, some in maximal_repeats(text, at, np.full(len(text), len(text)), before, 2)}
        want = set()
        for i in range(len(text)):
            for n in range(2, len(text) - i):
                own = tuple(j for j in range(len(text) - n + 1) if text[j : j + n] == text[i : i + n])
                if len(own) > 1 and len({text[j + n : j + n + 1] for j in own}) > 1 and len({text[j - 1] if j else -1 for j in own}) > 1:
                    want.add((n, own))
        assert got == want


def test_deepest_repeat_of_a_smaller_id():
    r = random.Random(7)
    for _ in range(60):
        text = np.frombuffer(bytes(r.choice(b"ab") for _ in range(60)), np.uint8)
        at, ids = np.arange(60), np.array([r.randrange(4) for _ in range(60)])
        order, common = suffix.suffix_array(text, at, np.full(60, 60))
        raw = text.tobytes()
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in at)
        left = np.arange(60) % 2 - np.where(np.arange(60) % 3 == 0, 100 + np.arange(60), 0)
        tree = suffix.interval_tree(common, left, ids[order], 3)
        best = suffix.deepest_of_others(tree, ids[order])
        for i in range(60):
            own = [v for v in range(len(tree.depth)) if tree.lo[v] <= i < tree.hi[v] and len(set(left[tree.lo[v] : tree.hi[v]])) > 1 and ids[order][tree.lo[v] : tree.hi[v]].min() < ids[order[i]]]
            assert best[i] == (max(own, key=lambda v: tree.depth[v]) if own else -1)


@pytest.mark.parametrize("kind", ["shifted", "periodic"])
def test_memory_of_one_range_is_linear(kind):
    import tracemalloc

    r = random.Random(3)
    if kind == "shifted":  # near copies of one passage, cut at other places
        base = bytes(r.choice(b"abcdefgh ") for _ in range(400))
        texts = [bytes([r.randrange(97, 123)]) + base[r.randrange(90) :][: r.randrange(60, 300)] + bytes([r.randrange(97, 123)]) for _ in range(10_000)]
    else:
        texts = [(b"ab" * 200)[i % 2 :][: 60 + i % 240] + b"%d" % i for i in range(10_000)]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    tracemalloc.start()
    of, start, length = suffix.repeats_among(data, size, np.arange(len(texts)), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * len(data) and len(of) <= len(data)
    seen, gone = set(), [np.zeros(n, bool) for n in size[:300]]
    for i, a, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True):
        if i < len(gone):
            gone[i][a : a + n] = True
    for t, found in zip(texts, gone, strict=False):
        want = np.zeros(len(t), bool)
        windows = [t[p : p + 50] for p in range(len(t) - 49)]
        for p, w in enumerate(windows):
            want[p : p + 50] |= w in seen
        assert (want == found).all()
        seen |= set(windows)


def test_any_column_names(spark):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(200))
    df = spark.createDataFrame([(1, text, 5, 6, 7, 8), (2, "xy" + text, 9, 10, 11, 12)], "doc_id long, text string, __id int, spans int, __text int, kept int")
    got = sorted(tuple(r) for r in drop_repeats(df).collect())
    assert got == [(1, text, 5, 6, 7, bytearray(text, "utf8"), 0, []), (2, "xy" + text, 9, 10, 11, bytearray(b"xy"), 200, [(2, 202)])]


def test_what_a_task_has_sent_is_not_sent_again(spark, monkeypatch):
    """One line in all documents, in many small chunks of few tasks, with a short memory and a long one."""
    r = random.Random(11)
    line = " the same line of words that every document of the corpus has, and which is longer than fifty bytes."
    docs = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randrange(5, 60))) + line + (line[:70] if i % 3 else "") + "".join(r.choice("abcdefgh ") for _ in range(9))) for i in range(200)]
    r.shuffle(docs)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([0] * len(docs)), pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["__id", "__row", "__at", "__text"])
    sent = {}
    for remembered in (60_000, 3, 0):
        monkeypatch.setattr(suffix, "REMEMBERED", remembered)
        typed = pa.schema([("part", pa.int32()), ("r", pa.int32()), ("blob", pa.binary())])
        table = lambda rows: iter(pa.Table.from_batches([pa.RecordBatch.from_pydict(d).cast(typed) for d in rows]).sort_by([("part", "ascending"), ("r", "ascending")]).to_batches())  # noqa: B023, E731
        keys = {}
        for d in suffix._gather(table(suffix._shared(3)(table(suffix._anchors(50, 3, 3, "__text")(iter([batch])))))):
            keys |= dict(zip((int(i) for i in d["__at"]), d["keys"], strict=True))
        keyed = batch.append_column("keys", pa.array([keys.get(i, b"") for i, _ in docs], pa.binary()))
        rows = list(suffix._spread(50, 4, 2, "__text")(iter([keyed])))
        sent[remembered] = sum(len(b) for d in rows if d["part"] == [0] for b in d["blob"])
        spans = {}
        for d in suffix._merge(table(suffix._find(50, 2)(table(rows)))):
            spans |= {int(i): np.frombuffer(b, np.int64).reshape(2, -1) for i, b in zip(d["__id"], d["spans"], strict=True)}
        for i, _, removed, n, _ in brute(docs):
            a = spans.get(i, np.zeros((2, 0), int))
            assert (int((a[1] - a[0]).sum()), a.shape[1]) == (removed, n)
    assert sent[60_000] < 0.9 * sent[0]
