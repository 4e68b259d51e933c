"""Language identification with averaged hashed subword embeddings.

A text is lower-cased in ASCII, everything in ASCII but letters becomes one
space class, and its subwords are the byte n-grams of 2, 3 and 4 bytes within
words, word boundaries included. Each subword is hashed to one of `buckets`
embeddings; a text is the average of its subwords' embeddings, and a linear
softmax over it gives the languages. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, one text at a step.

A share of the training rows is set aside to calibrate: a temperature is
chosen that minimises their log loss, and a text is rejected when its
calibrated probability falls below a threshold that is at most `reject_below`
and is low enough to reject at most `reject_share` of the set-aside texts that
were right. Texts without a letter are `und`, with score 0.

Training sees at most `per_label` rows of each language and `total` rows, drawn
by a hash of the text; their whole texts are counted on the executors. Scoring
reads every whole text and is one pass without a shuffle: embeddings and
softmax are multiplied out into one row of logits for each bucket.

Nulls and odd input: a null or empty text is `und`; a text whose only letters
stand alone at its ends may have no subword, and then has the probabilities of
the bias; rows without a label don't
train; without any training row every text is `und`; with a single language
every text with a letter gets it. Input columns named like results are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.learn import Sparse, sample_features
from tessera.llm.shared import give_back, map_texts, others
from tessera.llm.text import rows

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def subwords(column: pa.Array):
    """For each n-gram order the start bytes and the buckets of all subwords; and the text boundaries."""
    data, at = rows(column)
    data = _FOLD[data]
    space, out = data == 32, []
    cut = at[1:-1]
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = data[:m].astype(np.uint32)
        ok = ~(space[:m] & space[n - 1 :])
        for j in range(1, n):
            h *= np.uint32(0x01000193)
            h ^= data[j : j + m]
            if j < n - 1:
                ok &= ~space[j : j + m]
        h *= np.uint32(0x9E3779B1)
        for j in range(1, n):  # no subword goes on into the next text
            past = cut - j
            ok[past[(past >= 0) & (past < m)]] = False
        where = np.flatnonzero(ok)
        out.append((where, (h[where] >> np.uint32(32 - 15)).astype(np.int32)))
    return out, at


def _counter():
    def count(column: pa.Array) -> Sparse:
        parts, at = subwords(column)
        where = np.concatenate([w for w, _ in parts] or [np.zeros(0, np.int64)])
        feature = np.concatenate([f for _, f in parts] or [np.zeros(0, np.int32)])
        return Sparse.count(np.searchsorted(at, where, "right") - 1, feature, len(column), BUCKETS)

    return count


class Model:
    """Languages, logits by bucket, bias, temperature and rejection threshold."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.langs, self.logits, self.bias, self.temperature, self.threshold = langs, logits, bias, temperature, threshold

    def raw(self, x: Sparse) -> np.ndarray:
        out = np.zeros((len(x), len(self.langs)))
        for i in range(len(x)):
            f, v = x.row(i)
            if len(f):
                out[i] = v @ self.logits[f] / v.sum() + self.bias
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(langs: list[str], label: np.ndarray, x: Sparse, *, dim: int = DIM, epochs: int = 5, least_steps: int = 12_000, rate: float = 0.5, scale: float = 40.0, held: int = 10, reject_below: float = 0.5, reject_share: float = 0.001, seed: int = 7) -> Model:
    """Fits by SGD; every held-th row calibrates. scale: step of embeddings against that of the softmax, as averages share a step among many."""
    r = np.random.default_rng(seed)
    c = len(langs)
    if c < 2 or not len(x):
        return Model(langs, np.zeros((BUCKETS, c), np.float32), np.zeros(c), 1.0, 0.0)
    inner = np.array([i % held != held - 1 for i in range(len(x))])
    embed, out, bias = r.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)), np.zeros((dim, c)), np.zeros(c)
    own = np.flatnonzero(inner)
    epochs = max(epochs, -(-least_steps // max(1, len(own))))
    steps, step = max(1, epochs * len(own)), 0
    for _ in range(epochs):
        for i in r.permutation(own):
            step += 1
            f, v = x.row(i)
            if not len(f):
                continue
            lr, w = rate * (1 - step / (steps + 1)), v / v.sum()
            hidden = w @ embed[f]
            g = softmax(hidden @ out + bias)
            g[label[i]] -= 1
            back = out @ g
            out -= lr * np.outer(hidden, g)
            bias -= lr * 0.1 * g
            embed[f] -= lr * scale * np.outer(w, back)
    model = Model(langs, (embed @ out).astype(np.float32), bias, 1.0, 0.0)
    test = np.flatnonzero(~inner)
    if len(test):
        z, y = model.raw(Sparse(np.concatenate(([0], np.cumsum(np.diff(x.cuts)[test]))), np.concatenate([x.row(i)[0] for i in test]), np.concatenate([x.row(i)[1] for i in test]))), label[test]
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 26), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(min(reject_below, np.quantile(right, reject_share))) if len(right) else 0.0
    return model


def _has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter: by byte for ASCII, by code point only where no ASCII letter is."""
    data, at = rows(column)
    ascii_letters = np.concatenate(([0], np.cumsum((_FOLD[data] >= 97) & (data < 128))))
    out = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(ch.isalpha() for ch in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _score(model: Model):
    table, c = model.logits, len(model.langs)

    def run(column: pa.Array) -> list[pa.Array]:
        parts, at = subwords(column)
        total, n = np.zeros((len(column), c)), np.zeros(len(column))
        for where, bucket in parts:
            cuts = np.searchsorted(where, at)
            filled = np.flatnonzero(np.diff(cuts))
            n += np.diff(cuts)
            for j in range(c):
                if len(filled):
                    total[filled, j] += np.add.reduceat(table[:, j][bucket], cuts[:-1][filled], dtype=np.float64)
        p = softmax((total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature) if c else np.zeros((len(column), 0))
        letters = _has_letter(column) & (c > 0)
        best, score = (p.argmax(axis=1), p.max(axis=1)) if c else (np.zeros(len(column), int), np.zeros(len(column)))
        names = pa.array([model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], pa.string())
        return [names, pa.array(np.where(letters, score, 0.0)), pa.array(~letters | (score < model.threshold))]

    return run


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", per_label: int = 1000, total: int = 4000, **more) -> Model:
    """Trains on rows with a label: at most per_label of each and total in all."""
    names, x = sample_features(labelled.where(F.col(lang).isNotNull()), lang, text, per_label, total, "lang", _counter)
    langs = sorted(set(names))
    number = {name: i for i, name in enumerate(langs)}
    model = train(langs, np.array([number[n] for n in names], int), x, **more)
    del x
    give_back()
    return model


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of docs with lang_pred, score (calibrated probability) and rejected."""
    keep = others(docs.select(*keep) if keep else docs, [f.name for f in FIELDS])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of logits, whatever the corpus
    return map_texts(docs, text, keep, FIELDS, lambda: _score(shared.value), limit=1 << 18)

