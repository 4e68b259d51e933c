"""Hard-negative mining by norm-bucketed exact inner-product search.

Vectors become integers and are written once as a table sorted by length
(Euclidean norm), longest first. Anchors are read in batches of bounded bytes;
each batch makes two passes over that table. In a pass a task takes its rows
bucket by bucket, and scores a bucket only with those anchors for which it can
still matter: by Cauchy-Schwarz no row of the bucket scores above the anchor's
length times the bucket's greatest length, so an anchor is left out where that
is below what it needs.

* Positives: the best rows of the anchor's own label. What an anchor needs is
  its running k-th score.
* Negatives: for each positive the best rows of other labels whose score lies
  in the window from `low` to `high` percent of the positive's score. What a
  window needs is its lower limit or its running k-th score, if that is higher.

Lengths are rounded up, so pruning is exact, and a tie with the k-th score is
never pruned. Tasks give at most k rows for each anchor or window; a ranked
window of Spark, which also ranks before its shuffle, merges them.

Nulls and odd input: rows with a null label, a null id, a null vector or a
null or non-finite component take no part; vectors of unequal length meet in
their common components, an empty one scores 0 with all; ties go to the
smaller id; rows with the anchor's own id are never its positives or negatives;
rows that repeat an id are rows of their own, as anchors (each gives its own
result) and as candidates; a window of a negative positive score is empty; an
empty table, or one without anchors, gives an empty result. Vectors are read by
the columns named, so others, whatever their names, are left out. Scores are
64-bit integers; where lengths allow a score beyond 62 bits nothing is pruned
and arithmetic wraps around.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows, partitions, saved, spent
from tessera.llm.topk import integer_matrix

BUCKET, TILE = 1024, 256
STATE = 1024  # bytes that a task keeps for each anchor, about
NONE = np.iinfo(np.int64).min
EXACT = float(1 << 52)  # sums of integers up to this are exact in doubles
FOUND = "q long, anchor_id long, slot int, vec_id long, score long"


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, rounded up a little."""
    wide = rows.astype(np.float64)
    return np.sqrt((wide * wide).sum(axis=1)) * (1 + 1e-9)


class Asked:
    """A batch of anchors with `slots` searches each, of which each keeps its k best rows.

    floor and top, one for each slot, bound the scores that count.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, floor: np.ndarray, top: np.ndarray, same: bool) -> None:
        self.ids, self.labels, self.rows, self.floor, self.top, self.same = ids, labels, rows, floor, top, same
        self.lengths = lengths(rows)


class Search:
    """What a task has found for a batch so far."""

    def __init__(self, asked: Asked, k: int) -> None:
        self.asked, self.k = asked, k
        shape = (*asked.floor.shape, k)
        self.score, self.vec_id, self.filled = np.full(shape, NONE), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.need = asked.floor.copy()
        self.scored = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """Searches a bucket."""
        asked = self.asked
        longest = lengths(rows).max(initial=0.0)
        reach = asked.lengths * longest
        wraps = reach.max(initial=0.0) >= float(1 << 62)
        live = np.flatnonzero((reach[:, None] >= self.need.astype(np.float64)).any(axis=1) | wraps)
        self.scored += len(live) * len(ids)
        kind = np.float64 if reach.max(initial=0.0) < EXACT and longest < EXACT and asked.lengths.max(initial=0.0) < EXACT else np.int64
        columns = np.ascontiguousarray(rows.T, dtype=kind)
        for at in range(0, len(live), TILE):
            some = live[at : at + TILE]
            scores = (asked.rows[some].astype(kind) @ columns).astype(np.int64)
            fits = (asked.labels[some, None] == labels) == asked.same
            fits &= asked.ids[some, None] != ids
            for slot in range(asked.floor.shape[1]):
                hit = fits & (scores >= self.need[some, slot, None]) & (scores <= asked.top[some, slot, None])
                a, row = np.nonzero(hit)
                if len(a):
                    self.keep(some[a], slot, ids[row], scores[a, row])

    def keep(self, a: np.ndarray, slot: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """The k best of what was kept and what is new, ties to the smaller id; a is ascending."""
        k, who = self.k, np.unique(a)
        old = self.filled[who, slot]
        a = np.concatenate((a, np.repeat(who, old.sum(axis=1))))
        ids, scores = np.concatenate((ids, self.vec_id[who, slot][old])), np.concatenate((scores, self.score[who, slot][old]))
        order = np.lexsort((ids, -scores, a))
        a, ids, scores = a[order], ids[order], scores[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < k
        a, place = a[top], place[top]
        self.score[a, slot, place], self.vec_id[a, slot, place], self.filled[a, slot, place] = scores[top], ids[top], True
        full = who[self.filled[who, slot, k - 1]]
        self.need[full, slot] = np.maximum(self.need[full, slot], self.score[full, slot, k - 1])

    def rows(self) -> dict:
        a, slot, place = np.nonzero(self.filled)
        return {"q": a, "anchor_id": self.asked.ids[a], "slot": slot, "vec_id": self.vec_id[a, slot, place], "score": self.score[a, slot, place]}


def _buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of BUCKET rows at a time, as they come."""
    for batch in batches:
        ids, labels = (np.asarray(batch.column(c), dtype=np.int64) for c in ("vec_id", "label"))
        rows = integer_matrix(batch.column("w"), width)
        for lo in range(0, len(ids), BUCKET):
            yield ids[lo : lo + BUCKET], labels[lo : lo + BUCKET], rows[lo : lo + BUCKET]


def _pass(rows: DataFrame, asked: Asked, k: int) -> DataFrame:
    """The k best rows of each anchor and slot, with rank."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        search = Search(shared.value, k)
        for bucket in _buckets(batches, search.asked.rows.shape[1]):
            search.add(*bucket)
        yield search.rows()

    found = map_rows(rows.select("vec_id", "label", "w"), FOUND, run)
    by = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "vec_id")
    best = saved(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k))
    shared.destroy()
    return best


def by_length(vectors: DataFrame, vec_id: str, label: Column, vector: str, scale: int, is_anchor: Column) -> DataFrame:
    """A saved table of the rows that take part, as integers, longest first.

    Rows are dealt out by ranges of length; those of one length by their place in the input, so no range is larger than others.
    """
    x = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    weights = F.transform(vector, lambda c: F.floor(x(c) * F.lit(float(scale))))
    rows = vectors.where(F.col(vector).isNotNull() & label.isNotNull() & ~bad)
    rows = rows.select(F.col(vec_id).try_cast("long").alias("vec_id"), label.try_cast("long").alias("label"), weights.alias("w"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null").withColumn("length", F.sqrt(F.aggregate("w", F.lit(0.0), lambda n, c: n + x(c) * x(c)))).withColumn("at", F.monotonically_increasing_id())
    parts = partitions(vectors.sparkSession, 0)
    return saved(rows.repartitionByRange(parts, F.desc("length"), "at").sortWithinPartitions(F.desc("length"), "at"))


def percent_of(score: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * score / 100) without overflow."""
    return score // 100 * percent - (-(score % 100) * percent // 100)


def batches_of(anchors: DataFrame, most: int) -> tuple[int, Column]:
    """How many batches of about `most` bytes the anchors make, and which of them a row belongs to."""
    size = anchors.agg(F.sum(F.size("w") * 8 + STATE)).first()[0] or 0
    parts = -(-size // most)
    return parts, F.pmod(F.xxhash64("at"), F.lit(max(1, parts)))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", label: Column | str = "label", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, batch_bytes: int = 16 << 20,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row where is_anchor holds.

    A negative's score is at least `low` and at most `high` percent of its positive's.
    """
    spark = vectors.sparkSession
    rows = by_length(vectors, vec_id, F.col(label) if isinstance(label, str) else label, vector, scale, is_anchor)
    anchors = rows.where("anchor")
    parts, part = batches_of(anchors, batch_bytes)
    done = [_mine(rows, anchors.where(part == p), positives, negatives, low, high) for p in range(parts)]
    spent(rows)
    return reduce(DataFrame.unionByName, done) if done else _empty(spark)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def _mine(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """hard_negatives for a batch of anchors, as a saved table."""
    got = anchors.select("vec_id", "label", "w").toArrow()  # a batch of the stated anchors
    ids, labels = (np.asarray(got.column(c), dtype=np.int64) for c in ("vec_id", "label"))
    matrix = integer_matrix(got.column("w"))
    any_score = np.full((len(ids), 1), NONE), np.full((len(ids), 1), np.iinfo(np.int64).max)
    best = _pass(rows, Asked(ids, labels, matrix, *any_score, same=True), positives)
    table = best.select("q", "rank", "score").toArrow()  # at most `positives` rows for each anchor of the batch
    q, slot, score = (np.asarray(table.column(c), dtype=np.int64) for c in ("q", "rank", "score"))
    floor, top = np.full((len(ids), positives), np.iinfo(np.int64).max), np.full((len(ids), positives), NONE)
    floor[q, slot - 1], top[q, slot - 1] = percent_of(score, low), -percent_of(-score, high)
    found = _pass(rows, Asked(ids, labels, matrix, floor, top, same=False), negatives)
    window = best.select("q", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = found.select("q", "anchor_id", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(window, ["q", "slot"])
    out = saved(both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    spent(best, found)
    return out
