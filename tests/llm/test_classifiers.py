import zlib

import numpy as np
import pytest

from tessera.llm import langid, toxicity
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(None, "hello"), (1, None), (2, ""), (3, "123 !!"), (4, "é" * 5), (5, "the " * 60_000), (5, "the " * 60_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_language_of_odd_texts(spark, docs):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    model = langid.fit(docs.select("text", "lang"), per_label=60)
    got = [(r.lang_pred == "und", r.rejected) for r in langid.identify(odd, model).collect()]
    assert [g[0] for g in got] == [False, True, True, True, False, False, False] and all(r or not u for u, r in got)
    none = langid.fit(docs.select("text", "lang").limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'").select("text", "lang"), per_label=5)
    assert {r.lang_pred for r in langid.identify(odd.withColumnRenamed("doc_id", "score"), one).collect()} == {"und", "en"}
    assert langid.identify(odd.limit(0), one).collect() == []


def test_language_gradient_lowers_the_loss():
    cuts = np.arange(0, 41, 2)
    x = langid.Sparse(cuts, np.array([0, 1, 2, 3] * 10, np.int32), np.ones(40, np.float32))
    model = langid.train(["a", "b"], np.array([0, 1] * 10), x)
    assert (model.raw(x).argmax(axis=1) == np.array([0, 1] * 10)).all()


def plain_subwords(text):
    """Bucket of each byte n-gram of 2 to 4 bytes within a text's words, their boundaries included."""
    folded = [b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode()]
    out = []
    for n in (2, 3, 4):
        for i in range(len(folded) - n + 1):
            gram = folded[i : i + n]
            if 32 in gram[1:-1] or gram[0] == gram[-1] == 32:
                continue
            h = gram[0]
            for b in gram[1:]:
                h = (h * 0x01000193 % 2**32) ^ b
            out.append((h * 0x9E3779B1 % 2**32) >> 17)
    return out


def test_language_scores_match_plain_loops(spark):
    r = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], r.normal(size=(langid.BUCKETS, 3)).astype(np.float32), r.normal(size=3), 1.7, 0.4)
    texts = [" ".join("".join(r.choice(list("abcdeéÜx9.")) for _ in range(r.integers(1, 8))) for _ in range(r.integers(1, 30))) for _ in range(60)]
    rows = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3), model).collect()
    for row in rows:
        z = list(model.bias)
        own = plain_subwords(row.text)
        for b in own:
            for j in range(3):
                z[j] += float(model.logits[b, j]) / len(own)
        e = [np.exp(x / 1.7) for x in z]
        p = [x / sum(e) for x in e]
        if any(ch.isalpha() for ch in row.text):
            assert row.lang_pred == "abc"[int(np.argmax(p))] and row.score == pytest.approx(max(p), abs=1e-6) and row.rejected == (row.score < 0.4)
        else:
            assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def test_language_training_matches_plain_loops():
    r = np.random.default_rng(5)
    rows = [(sorted({int(f) for f in r.integers(0, 50, 6)}), i % 3) for i in range(30)]
    cuts = np.cumsum([0] + [len(f) for f, _ in rows])
    values = [[float(v) for v in r.integers(1, 4, len(f))] for f, _ in rows]
    x = langid.Sparse(cuts, np.array([b for f, _ in rows for b in f], np.int32), np.array([v for own in values for v in own], np.float32))
    got = langid.train(["a", "b", "c"], np.array([y for _, y in rows]), x, dim=4, epochs=2, least_steps=1, rate=0.3, scale=5.0, held=10)
    s = np.random.default_rng(7)
    embed = s.uniform(-1 / 4, 1 / 4, (langid.BUCKETS, 4)).tolist()
    out, bias = [[0.0] * 3 for _ in range(4)], [0.0] * 3
    own = [i for i in range(30) if i % 10 != 9]
    step = 0
    for _ in range(2):
        for i in s.permutation(own):
            step += 1
            lr = 0.3 * (1 - step / (2 * len(own) + 1))
            (f, y), v = rows[i], values[i]
            hidden = [sum(w / sum(v) * embed[b][d] for b, w in zip(f, v, strict=True)) for d in range(4)]
            z = [sum(hidden[d] * out[d][c] for d in range(4)) + bias[c] for c in range(3)]
            e = [np.exp(t) for t in z]
            g = [e[c] / sum(e) - (c == y) for c in range(3)]  # of the log loss
            back = [sum(out[d][c] * g[c] for c in range(3)) for d in range(4)]
            for c in range(3):
                for d in range(4):
                    out[d][c] -= lr * hidden[d] * g[c]
                bias[c] -= lr * 0.1 * g[c]
            for b, w in zip(f, v, strict=True):
                for d in range(4):
                    embed[b][d] -= lr * 5.0 * w / sum(v) * back[d]
    want = np.array(embed[:50]) @ np.array(out)
    assert np.allclose(got.logits[:50], want, atol=1e-5) and np.allclose(got.bias, bias, atol=1e-9)


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_toxicity_training_matches_plain_loops(prior):
    """The risk's gradient by differences, and Adam in plain loops; the larger prior turns the negative part."""
    r = np.random.default_rng(3)
    rows = [sorted({int(f) for f in r.integers(0, 12, 5)}) for _ in range(40)]
    x = toxicity.Sparse(np.cumsum([0] + [len(f) for f in rows]), np.array([b for f in rows for b in f], np.int32), np.ones(sum(map(len, rows)), np.float32))
    positive = np.array([i % 4 == 0 for i in range(40)])
    got = toxicity.train(positive, np.zeros(40, bool), x, prior, epochs=3, batch=8, rate=0.1, decay=1e-3, least_rows=1, held=5)
    s = np.random.default_rng(11)
    pos, unl = [i for i in range(40) if i % 5 != 4 and positive[i]], [i for i in range(40) if i % 5 != 4 and not positive[i]]
    theta, m, v, step, turned = [0.0] * 13, [0.0] * 13, [0.0] * 13, 0, 0  # twelve weights and the bias
    soft = lambda t: float(np.log1p(np.exp(-abs(t))) + max(t, 0))
    score = lambda t, i: sum(t[b] for b in rows[i]) + t[12]
    steps = 3 * -(-len(unl) // 8)
    for _ in range(3):
        order = s.permutation(np.array(unl))
        for lo in range(0, len(order), 8):
            u = order[lo : lo + 8]
            p = s.choice(np.array(pos), min(len(pos), 8), replace=False)
            step += 1
            negative = lambda t: sum(soft(score(t, i)) for i in u) / len(u) - prior * sum(soft(score(t, i)) for i in p) / len(p)  # noqa: B023, E731
            risk = lambda t: prior * sum(soft(-score(t, i)) for i in p) / len(p) + negative(t)  # noqa: B023, E731
            aim = risk if negative(theta) >= 0 else lambda t: -negative(t)  # noqa: B023
            turned += negative(theta) < 0
            grad = []
            for j in range(13):
                up, down = list(theta), list(theta)
                up[j] += 1e-5
                down[j] -= 1e-5
                grad.append((aim(up) - aim(down)) / 2e-5 + (1e-3 * theta[j] if j < 12 else 0))
            lr = 0.1 * (1 - (step - 1) / steps)
            for j in range(13):
                m[j], v[j] = 0.9 * m[j] + 0.1 * grad[j], 0.999 * v[j] + 0.001 * grad[j] ** 2
                theta[j] -= lr * (m[j] / (1 - 0.9**step)) / ((v[j] / (1 - 0.999**step)) ** 0.5 + 1e-8)
    assert np.allclose(got.weights[:12], theta[:12], atol=1e-3) and got.bias == pytest.approx(theta[12], abs=1e-3)
    assert (turned > 0) == (prior > 0.5)


def test_toxicity_scores_match_plain_loops(spark):
    r = np.random.default_rng(4)
    model = toxicity.Model(r.normal(size=1 << toxicity.BITS).astype(np.float32), 0.3, 1.4, -0.2)
    texts = ["bad Bad awful-thing straßenbahn x", "", "onewordthatislong onewordthatislonger", "a b c 12345 123456"]
    rows = toxicity.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), model).collect()
    words = toxicity.Words(toxicity.ALNUM)
    bucket = lambda b: int(words.hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0] >> np.uint64(64 - toxicity.BITS))
    start = lambda b, n: int(words.prefixes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), (n,))[0][1][0] >> np.uint64(64 - toxicity.BITS))
    import re

    for row in rows:
        own = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", row.text)]
        z = sum(float(model.weights[bucket(w)]) for w in own) + sum(float(model.weights[start(w, n)]) for w in own for n in toxicity.LENGTHS if len(w) >= n)
        z = z * toxicity.SCALE / (len(own) + toxicity.SMOOTH) + 0.3
        assert row.score == pytest.approx(1 / (1 + np.exp(-(1.4 * z - 0.2))), abs=1e-6)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op10_toxicity"](spark, sf).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([p == t for p, t in held]) > 0.95
    assert np.mean([p for p, t in held if t]) > 0.75 and np.mean([p for p, t in held if not t]) < 0.03


def test_toxicity_of_odd_texts(spark):
    texts = [(i, f"bad{i} awful thing") for i in range(30)] + [(100 + i, f"nice{i} sweet thing") for i in range(60)] + [(900, None), (None, "awful")]
    train = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(0, 0), (900, 1), (None, 1), (101, None)] + [(100 + i, 0) for i in range(0, 60, 2)], "doc_id long, label int")
    model = toxicity.fit(train, labels)
    odd = spark.createDataFrame([*ODD, (9, "awful"), (9, "sweet")], "doc_id long, text string")
    got = toxicity.rate(odd, model).collect()
    assert len(got) == len(ODD) + 2 and got[-2].score > got[-1].score and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.rate(odd, toxicity.fit(train, labels.where("label = 0"))).collect()} == {0.0}
    assert {r.score for r in toxicity.rate(odd, toxicity.fit(train.limit(0), labels.limit(0))).collect()} == {0.0}


def test_bounds_on_the_toxicity_sample_do_not_move_the_decision(spark):
    """Of those who say awful 37 in 100 are toxic, whatever the share of toxic rows in the sample."""
    texts = [(i, 1, "awful thing" if i % 10 < 7 else "sweet thing") for i in range(1000)]
    texts += [(10_000 + i, 0, "awful thing" if i % 20 < 3 else "sweet thing") for i in range(8000)]
    rows = spark.createDataFrame(texts, "doc_id long, label int, text string")
    odd = spark.createDataFrame([("awful thing",), ("sweet thing",)], "text string")
    for more in ({"positives": 1000, "unlabelled": 8000}, {"positives": 800, "unlabelled": 800}):
        awful, sweet = toxicity.rate(odd, toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "label"), **more)).collect()
        assert 0.25 < awful.score < 0.49 and awful.predicted == 0 and sweet.score < 0.1
