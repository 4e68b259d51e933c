"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Every component of a vector is a term with an integer weight, and a vector's
non-zero components are its sparse row. Candidates are cut into blocks; a
block's postings are, for each term, the weights of its rows. For each term of
a query, the query's weight times the posting list is scattered into the
query's dense score array over the block; no term, row or pair is skipped.
Partition selection (introselect) then keeps each query's k best rows of the
block. What blocks have kept is cut to k again in each task, and Spark merges
the tasks' lists with a ranked window that also ranks before its shuffle.

Queries are the set that the caller states. They are read in batches of about
`batch_bytes` of vectors and what is kept for them. Each batch goes to all tasks and makes one pass over the
candidates, whose results are saved before the next batch is read, so neither
side is ever held whole. In a task the queries are scored TILE at a time.

Nulls and odd input: vectors that are null or hold a null or non-finite
component, and rows without an id or with one that is no number, take no part; vectors of unequal length
meet in their common terms; ties go to the smaller id; rows with the query's
own id are not its candidates, so rows that repeat an id never find each
other, and as queries they count once for each row; an empty table, or one
without queries, gives an empty result. Vectors are read by the two columns
named, so others, whatever their names, are left out. Scores are 64-bit
integers; arithmetic beyond them wraps around.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows, saved

BLOCK, TILE = 2048, 512
RESULT = "q long, query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id and floor(scale * component) of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    weights = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return df.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & ~bad).select(F.col(vec_id).try_cast("long").alias("vec_id"), weights.alias("w")).where("vec_id is not null")


def integer_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a dense integer matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = np.asarray(column.flatten(), dtype=np.int64), np.diff(np.asarray(column.offsets))
    width = width if width is not None else int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    inside = np.arange(int(sizes.max(initial=0))) < sizes[:, None]
    row, at = np.nonzero(inside)
    fits = at < width
    out[row[fits], at[fits]] = flat[fits]
    return out


def _narrow(queries: np.ndarray, block: np.ndarray) -> type:
    """The smallest type whose sums can't overflow."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(block).max(initial=0)) * max(1, queries.shape[1])
    return np.int32 if 0 <= most < 2**31 and np.abs(block).max(initial=0) < 2**31 else np.int64


def _scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Term at a time: each non-zero query weight scatters its term's postings into the query's scores."""
    kind = _narrow(queries, block)
    postings = np.ascontiguousarray(block.T, dtype=kind)
    scores, part = np.zeros((len(queries), len(block)), kind), np.empty(len(block), kind)
    sparse, used = queries.astype(kind), np.flatnonzero(block.any(axis=0))
    for i, row in enumerate(sparse):
        own = scores[i]
        for t in used[row[used] != 0]:
            np.multiply(postings[t], row[t], out=part)
            own += part
    return scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ids are ascending."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kept_ids = [np.zeros(0, np.int64)] * len(queries)
        kept_scores = [np.zeros(0, np.int64)] * len(queries)

        def add(ids: np.ndarray, block: np.ndarray) -> None:
            order = np.argsort(ids, kind="stable")
            ids, block = ids[order], block[order]
            for at in range(0, len(queries), TILE):
                rank(ids, _scores(queries[at : at + TILE], block), at)

        def rank(ids: np.ndarray, scores: np.ndarray, at: int) -> None:
            lowest = np.iinfo(scores.dtype).min
            for q, own in enumerate(query_ids[at : at + TILE], at):
                lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                row, here = scores[q - at], ids
                if hi > lo:
                    row, here = np.delete(row, slice(lo, hi)), np.delete(ids, slice(lo, hi))
                full = len(kept_scores[q]) >= k
                best = np.flatnonzero(row >= (max(kept_scores[q].min(), lowest) if full else lowest)) if full else _best(here, row, k)
                if len(best) > k:
                    best = best[_best(here[best], row[best], k)]
                if not len(best):
                    continue
                some, value = np.concatenate((kept_ids[q], here[best])), np.concatenate((kept_scores[q], row[best].astype(np.int64)))
                by_id = np.argsort(some, kind="stable")
                some, value = some[by_id], value[by_id]
                top = _best(some, value, k)
                kept_ids[q], kept_scores[q] = some[top], value[top]

        wait_ids, wait_rows, waiting = [], [], 0
        for batch in batches:
            ids, block = np.asarray(batch.column("vec_id"), dtype=np.int64), integer_matrix(batch.column("w"), queries.shape[1])
            for lo in range(0, len(ids), BLOCK):
                wait_ids.append(ids[lo : lo + BLOCK])
                wait_rows.append(block[lo : lo + BLOCK])
                waiting += len(wait_ids[-1])
                if waiting >= BLOCK:
                    add(np.concatenate(wait_ids), np.concatenate(wait_rows))
                    wait_ids, wait_rows, waiting = [], [], 0
        if waiting:
            add(np.concatenate(wait_ids), np.concatenate(wait_rows))
        sizes = [len(x) for x in kept_ids]
        if sum(sizes):
            yield {"q": np.repeat(np.arange(len(queries)), sizes), "query_id": np.repeat(query_ids, sizes), "vec_id": np.concatenate(kept_ids), "score": np.concatenate(kept_scores)}

    return run


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, k: int = 20, batch_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row where is_query holds."""
    session = vectors.sparkSession
    rows = integer_vectors(vectors, vec_id, vector, scale)
    asked = integer_vectors(vectors.where(is_query), vec_id, vector, scale)
    size = asked.agg(F.sum(F.size("w") * 8 + k * 16 + 100)).first()[0] or 0
    parts = max(1, -(-size // batch_bytes))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    by, done = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"), []
    for p in range(parts):
        got = asked.where(part == p).toArrow()  # about `batch_bytes` of the stated queries
        ids, matrix = np.asarray(got.column("vec_id"), dtype=np.int64), integer_matrix(got.column("w"))
        shared = session.sparkContext.broadcast((ids, matrix))
        found = map_rows(rows, RESULT, lambda batches, shared=shared: _search(*shared.value, k)(batches))
        best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        if parts == 1:
            return best
        done.append(saved(best))
        shared.destroy()
    return reduce(DataFrame.unionByName, done)
