"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, whether
labelled or not, are unlabelled. With class prior pi and logistic losses, the
risk pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)]) is minimised over a
linear model: the unlabelled texts count as negatives less the share of
positives that hides among them, and where that difference turns negative the
step goes the other way, so that the model can't profit from overfitting it
(the non-negative estimator). The prior is the share of toxic rows among the
labelled ones. Confirmed positives are not drawn as unlabelled texts, and the
prior is not lowered for that: the slightly higher one was more accurate on
held-out labels. Confirmed negatives count as unlabelled in the risk; that they
are known is used only to place the decision, which is supervised, see below.

Features are hashed whole words and word beginnings of 5 to 8 bytes, in ASCII
lower case, weighted by their share of the text's words; the share is smoothed
by `smooth` words, so that a very short text needs more than one of them. The
optimiser is Adam in numpy over mini-batches. A fifth of the sample is set
aside to place the decision: a slope and an offset are fitted on it by
logistic regression, so 0.5 is where both classes are equally likely. Each
labelled row counts there by how many of all labelled rows of its class it
stands for, so the bounds on the sample don't move the decision.

Training sees at most `positives` and `unlabelled` rows, drawn by a hash of the
text; whole texts are counted on the executors. Scoring reads every whole text
in one pass without a shuffle.

Nulls and odd input: a null, empty or wordless text gets the score of a text
without features; rows without a label are unlabelled; rows without an id don't
train; without any positive
the score is 0 everywhere; rows of labels that repeat an id count as positive
if one of them is. Input columns named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.learn import Sparse, features, unit
from tessera.llm.shared import give_back, map_texts, others, saved
from tessera.llm.text import ALNUM, Words, rows

BITS, LENGTHS, SMOOTH = 18, (5, 6, 7, 8), 20.0
SCALE = 40.0
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def _features(words: Words, column: pa.Array):
    """(word numbers, buckets) for each kind of feature, and the word boundaries of the texts."""
    data, at = rows(column)
    starts, ends, before = words.split(data, at)
    kinds = [(np.arange(len(starts)), words.hashes(data, starts, ends)), *words.prefixes(data, starts, ends, LENGTHS)]
    return [(w, (h >> np.uint64(64 - BITS)).astype(np.int32)) for w, h in kinds], before


def _counter():
    words = Words(ALNUM)

    def count(column: pa.Array) -> Sparse:
        kinds, before = _features(words, column)
        row = np.searchsorted(before, np.concatenate([w for w, _ in kinds]), "right") - 1
        x = Sparse.count(row, np.concatenate([f for _, f in kinds]), len(column), 1 << BITS)
        x.value *= np.repeat(SCALE / (np.diff(before) + SMOOTH), np.diff(x.cuts)).astype(np.float32)
        return x

    return count


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0, trained: bool = True) -> None:
        self.weights, self.bias, self.slope, self.offset, self.trained = weights, bias, slope, offset, trained

    def raw(self, x: Sparse, some: np.ndarray) -> np.ndarray:
        return np.array([x.row(i)[1] @ self.weights[x.row(i)[0]] + self.bias for i in some])


def _gather(x: Sparse, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = x.cuts[some + 1] - x.cuts[some]
    at = np.repeat(x.cuts[some] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return np.repeat(np.arange(len(some)), sizes), x.feature[at], x.value[at]


def train(positive: np.ndarray, confirmed: np.ndarray, x: Sparse, prior: float, weight: np.ndarray | None = None, *, epochs: int = 40, batch: int = 512, rate: float = 0.1, decay: float = 1e-3, least_rows: int = 20, held: int = 5, seed: int = 11) -> Model:
    """positive: marked toxic; confirmed: labelled 0 or 1, used only to place the decision; weight: how many rows each stands for in that. Features in fewer than least_rows rows (or a hundredth of a small sample) don't count."""
    r, size = np.random.default_rng(seed), 1 << BITS
    common = np.bincount(x.feature, minlength=size) >= max(1, min(least_rows, len(x) // 100))
    x = Sparse(x.cuts, x.feature, x.value * common[x.feature])
    inner = np.arange(len(x)) % held != held - 1
    pos, unl = np.flatnonzero(inner & positive), np.flatnonzero(inner & ~positive)
    if not len(pos):
        return Model(np.zeros(size), 0.0, trained=False)
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb, step = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    steps = epochs * max(1, -(-len(unl) // batch))
    for _ in range(epochs):
        order = r.permutation(unl)
        for lo in range(0, max(1, len(order)), batch):
            u = order[lo : lo + batch]
            p = r.choice(pos, min(len(pos), batch), replace=False)
            some = np.concatenate((p, u))
            row, f, val = _gather(x, some)
            z = np.bincount(row, val * w[f], len(some)) + bias
            zp, zu = z[: len(p)], z[len(p) :]
            soft = lambda t: np.logaddexp(0, t)
            rest = (soft(zu).mean() if len(u) else 0.0) - prior * soft(zp).mean()
            g = np.zeros(len(some))
            if rest >= 0:
                g[: len(p)] = prior * (unit(zp) - 1 - unit(zp)) / len(p)
                g[len(p) :] = unit(zu) / max(1, len(u))
            else:  # the part for negatives is overfitted: undo it
                g[: len(p)] = prior * unit(zp) / len(p)
                g[len(p) :] = -unit(zu) / max(1, len(u))
            grad, gb, step = np.bincount(f, val * g[row], size) + decay * w, g.sum(), step + 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            a, b = 1 - 0.9**step, 1 - 0.999**step
            lr = rate * (1 - (step - 1) / steps)
            w -= lr * (m / a) / (np.sqrt(v / b) + 1e-8)
            bias -= lr * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    model = Model(w.astype(np.float32), float(bias))
    test = np.flatnonzero(~inner & confirmed)
    y = positive[test].astype(float)
    if 10 <= y.sum() <= len(y) - 10:
        z = model.raw(x, test)
        z0, spread = z.mean(), max(z.std(), 1e-9)
        c = np.ones(len(test)) if weight is None else weight[test] / weight[test].mean()
        z, theta = (z - z0) / spread, np.array([1.0, 0.0])
        loss = lambda t: (c * (np.logaddexp(0, t[0] * z + t[1]) - y * (t[0] * z + t[1]))).sum() + 0.05 * t[0] ** 2
        for _ in range(50):  # Newton's method, lightly regularised; a step that overshoots is halved
            q = unit(theta[0] * z + theta[1])
            k = c * q * (1 - q) + 1e-6
            h = np.array([[(k * z * z).sum() + 0.1, (k * z).sum()], [(k * z).sum(), k.sum() + 0.01]])
            move, part = np.linalg.solve(h, np.array([(c * (q - y) * z).sum() + 0.1 * theta[0], (c * (q - y)).sum()])), 1.0
            while part > 1e-6 and loss(theta - part * move) > loss(theta):
                part /= 2
            theta = theta - part * move
        if theta[0] > 0:
            model.slope, model.offset = float(theta[0] / spread), float(theta[1] - theta[0] * z0 / spread)
    return model


def _score(model: Model):
    words = Words(ALNUM)

    def run(column: pa.Array) -> list[pa.Array]:
        kinds, before = _features(words, column)
        z = np.zeros(len(column))
        for which, bucket in kinds:
            cuts = np.searchsorted(which, before)
            filled = np.flatnonzero(np.diff(cuts))
            if len(filled):
                z[filled] += np.add.reduceat(model.weights[bucket], cuts[:-1][filled], dtype=np.float64)
        z = z * SCALE / (np.diff(before) + SMOOTH) + model.bias
        score = unit(model.slope * z + model.offset) if model.trained else np.zeros(len(column))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return run


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "label", positives: int = 2500, unlabelled: int = 5000, **more) -> Model:
    """Trains on docs, of which those in labels are marked 1 or 0.

    The sample is drawn from ids and labels alone, so no text is shuffled.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("kind"))
    ids = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id")).distinct()
    marked = saved(ids.join(marks, "id", "left").select("id", F.coalesce("kind", F.lit(-1)).alias("label"), F.md5(F.concat(F.lit("toxic"), F.col("id").cast("string")).cast("binary")).alias("by")))
    known = marked.agg(*(F.count_if(F.col("label") == kind) for kind in (0, 1))).first()
    prior = known[1] / max(1, sum(known))
    # one draw over all texts that aren't confirmed toxic, so that it is mixed as the corpus is
    drawn = [marked.where(side).orderBy("by").limit(n) for side, n in ((F.col("label") == 1, positives), (F.col("label") != 1, unlabelled))]
    keys = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most positives + unlabelled rows
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(keys, "id").select("label", "text", "by")
    names, x = features(sample.dropDuplicates(["by"]), _counter)
    kinds = np.array(names, int)
    weight = np.ones(len(kinds))
    for kind, n in enumerate(known):
        weight[kinds == kind] = n / max(1, (kinds == kind).sum())
    model = train(kinds == 1, kinds >= 0, x, min(max(prior, 0.001), 0.9), weight, **more)
    del x
    give_back()
    return model


def rate(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of docs with score and predicted."""
    keep = others(docs.select(*keep) if keep else docs, [f.name for f in FIELDS])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the corpus
    return map_texts(docs, text, keep, FIELDS, lambda: _score(shared.value), limit=1 << 18)
