"""Shared parts of the two text classifiers: split, bounded samples and sparse features."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows, saved
from tessera.llm.text import pieces


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def unit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Sparse:
    """Rows of (feature, value) pairs in one flat array, each row's features unique."""

    def __init__(self, cuts: np.ndarray, feature: np.ndarray, value: np.ndarray) -> None:
        self.cuts, self.feature, self.value = cuts, feature, value

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[i], self.cuts[i + 1]
        return self.feature[a:b], self.value[a:b]

    @staticmethod
    def count(row: np.ndarray, feature: np.ndarray, n: int, size: int) -> Sparse:
        """Counts features by row; features lie below size."""
        both, times = np.unique(row.astype(np.int64) * size + feature, return_counts=True)
        return Sparse(np.searchsorted(both, np.arange(n + 1) * size), (both % size).astype(np.int32), times.astype(np.float32))


def sample_features(rows: DataFrame, label: str, text: str, most: int | None, total: int, seed: str, count: Callable[[], Callable[[pa.Array], Sparse]]) -> tuple[list, Sparse]:
    """Labels and features of a sample with at most `total` rows, and of each label `most` if given.

    Rows are drawn by a hash of their text, so the sample does not depend on
    how rows are laid out. Texts are counted whole on the executors; the
    driver gets the counts of the sample alone.
    """
    from pyspark.sql import Window

    by = F.md5(F.concat(F.lit(seed), F.col(text)).cast("binary"))
    drawn = rows.where(F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), by.alias("by"))
    keys = drawn.select("label", "by").distinct()
    if most:
        # of a label only the first ranges of the hash that hold `most` rows are ranked, so its task gets few more than those
        keys = saved(keys)
        digits = max(1, round(math.log(max(1, keys.count()), 16) / 2))  # as many ranges as keys in a range
        keys = keys.withColumn("part", F.substring("by", 1, digits))
        before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = keys.groupBy("label", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        last = parts.where(F.col("before") < most).groupBy("label").agg(F.max("part").alias("last"))  # a row for each label
        keys = keys.join(F.broadcast(last), "label").where(F.col("part") <= F.col("last"))
        keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("by"))).where(F.col("r") <= most).orderBy("r", "by")
    else:
        keys = keys.orderBy("by")
    keys = keys.limit(total).select("label", "by")
    return features(drawn.join(F.broadcast(keys), ["label", "by"], "left_semi").dropDuplicates(["label", "by"]), count)  # keys: at most `total`


def features(drawn: DataFrame, count: Callable[[], Callable[[pa.Array], Sparse]]) -> tuple[list, Sparse]:
    """Labels and features of a bounded sample (label, text, by), in the order of by."""

    def run(batches):
        kernel = count()
        for batch in batches:
            for lo, hi in pieces(batch.column("text")):
                x = kernel(batch.column("text").slice(lo, hi - lo))
                lists = [pa.ListArray.from_arrays(pa.array(x.cuts, pa.int32()), pa.array(v)) for v in (x.feature, x.value)]
                yield {"label": batch.column("label").slice(lo, hi - lo), "by": batch.column("by").slice(lo, hi - lo), "f": lists[0], "v": lists[1]}

    kind = drawn.schema["label"].dataType.simpleString()
    got = map_rows(drawn.select("label", "text", "by"), f"label {kind}, by string, f array<int>, v array<float>", run).toArrow().sort_by("by")
    f, v = got.column("f").combine_chunks(), got.column("v").combine_chunks()
    if isinstance(f, pa.ChunkedArray):
        f, v = pa.concat_arrays(f.chunks) if f.num_chunks else pa.array([], pa.list_(pa.int32())), pa.concat_arrays(v.chunks) if v.num_chunks else pa.array([], pa.list_(pa.float32()))
    cuts = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(f), 0), dtype=np.int64))))
    return got.column("label").to_pylist(), Sparse(cuts, np.asarray(f.flatten(), dtype=np.int32), np.asarray(v.flatten(), dtype=np.float32))
