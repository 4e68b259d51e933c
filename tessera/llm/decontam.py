"""Benchmark decontamination by winnowing.

A window is `span` consecutive words of a benchmark item; an item of fewer
words is one window. Winnowing takes, from each run of w = span - k + 1
consecutive k-gram hashes, the smallest one as the run's fingerprint. A run of
w k-grams is exactly a window of `span` words, so a text that shares a window
with an item also shares that window's fingerprint: no shared span of `span`
words or more is missed. Fingerprints of texts are joined with those of the
items, and each hit is extended to the whole window and compared word by word,
so hash collisions can't add hits. Items shorter than `span` are winnowed with
their own length as k and w = 1.

The benchmark is the small side: its fingerprints go to all tasks, and the
texts are read once and not shuffled. Its size is checked first. Beyond
`block_bytes` of text the benchmark is dealt out into blocks by item, and each
block makes its own pass over the texts, of which only the hits are kept, by
text; the last pass joins them to its rows.

Nulls and odd input: a null or empty text has no words and no hits; a null or
wordless item has no windows; a null item id counts as the empty string; rows
that repeat an item id add their windows to that item; repeated rows of texts
give repeated results; texts of any length are read whole; an empty table of texts
gives an empty result, and an empty benchmark no hits. Input columns named like
results are replaced by them; all others, whatever their names, are kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import map_texts, others, saved, small
from tessera.llm.text import ALNUM, LOWER, Words, grams, rows, sliding_min, spans_of

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


class Index:
    """Fingerprints and windows of some benchmark items, as flat arrays."""

    def __init__(self, items: list[tuple[str, str]], span: int, k: int) -> None:
        self.span, self.k = span, k
        self.ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        words = Words(ALNUM)
        self.item, self.plain, self.cuts = [], [], []  # of each row: its item, its words joined, where they begin there
        prints: dict[int, list] = defaultdict(list)  # by window length
        where: dict[int, list] = defaultdict(list)
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = words.split(data, np.array([0, len(data)]))
            if not len(starts):
                continue
            h, n = words.hashes(data, starts, ends), min(span, len(starts))
            own = [data[a:b].tobytes().translate(LOWER) for a, b in zip(starts, ends, strict=True)]
            prints[n].append(self.prints(h, n))
            g = grams(h, n)
            where[n].append(np.rec.fromarrays([g, np.full(len(g), len(self.item)), np.arange(len(g))], names="g,row,at"))
            self.item.append(number[item])
            self.plain.append(b" ".join(own))
            self.cuts.append(np.cumsum([0] + [len(x) + 1 for x in own]))
        self.sorted = {n: np.unique(np.concatenate(p)) for n, p in prints.items()}
        self.where = {n: (x := np.concatenate(p))[np.argsort(x["g"], kind="stable")] for n, p in where.items()}
        self.hash = {n: np.ascontiguousarray(x["g"]) for n, x in self.where.items()}
        self.bits, self.known = {}, {}
        for n, p in self.sorted.items():
            self.bits[n] = np.zeros(1 << 20, bool)
            self.bits[n][p & np.uint64((1 << 20) - 1)] = True

    def items(self, n: int, g: int, own: bytes) -> frozenset[int]:
        """Numbers of the items that have this window, given its hash and its words joined."""
        if own not in self.known:
            lo, hi = np.searchsorted(self.hash[n], np.uint64(g)), np.searchsorted(self.hash[n], np.uint64(g), "right")
            same = (self.where[n][x] for x in range(lo, hi))
            self.known[own] = frozenset(self.item[x["row"]] for x in same if self.plain[x["row"]][self.cuts[x["row"]][x["at"]] : self.cuts[x["row"]][x["at"] + n] - 1] == own)
            if len(self.known) > 200_000:
                self.known = {own: self.known[own]}
        return self.known[own]

    def prints(self, h: np.ndarray, n: int) -> np.ndarray:
        """The fingerprint of each window of n words."""
        k = min(self.k, n) if n == self.span else n
        g = grams(h, k)
        return sliding_min(g, n - k + 1) if len(g) >= n - k + 1 else g[:0]

    def candidates(self, h: np.ndarray, n: int) -> np.ndarray:
        f = self.prints(h, n)
        some = np.flatnonzero(self.bits[n][f & np.uint64((1 << 20) - 1)])
        at = np.searchsorted(self.sorted[n], f[some])
        return some[self.sorted[n][np.minimum(at, len(self.sorted[n]) - 1)] == f[some]]


def _kernel(index: Index):
    words = Words(ALNUM)

    def run(column: pa.Array) -> list[pa.Array]:
        data, at = rows(column)
        starts, ends, before = words.split(data, at)
        h = words.hashes(data, starts, ends)
        hit = np.zeros(len(h), bool)
        found: dict[int, set[int]] = defaultdict(set)
        for n in index.sorted:
            where = index.candidates(h, n)
            doc = np.searchsorted(before, where, "right") - 1
            inside = where + n <= before[doc + 1]
            where, doc = where[inside], doc[inside]
            if not len(where):
                continue
            need = (where[:, None] + np.arange(n)).reshape(-1)
            hashes = grams(h[need], n)[::n]
            known = index.hash[n][np.minimum(np.searchsorted(index.hash[n], hashes), len(index.hash[n]) - 1)] == hashes
            for i, d, g in zip(where[known].tolist(), doc[known].tolist(), hashes[known].tolist(), strict=True):
                own = b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n], strict=True)).translate(LOWER)
                if items := index.items(n, g, own):
                    hit[i : i + n] = True
                    found[d] |= items
        spans = []
        for d in range(len(column)):
            if d in found:
                a, b = spans_of(hit[before[d] : before[d + 1]])
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            else:
                spans.append([])
        items = [sorted(index.ids[x] for x in found[d]) if d in found else [] for d in range(len(column))]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(np.diff(before), pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]

    return run


def _merge_spans(a, b):
    """Union of two arrays of spans, as maximal spans."""
    ordered = F.array_sort(F.concat(a, b))
    start = F.array().cast(T.ArrayType(SPAN))
    return F.aggregate(
        ordered,
        start,
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, span: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """Each row of docs with n_words, hit_spans (word positions, end exclusive) and hit_items."""
    names = [f.name for f in FIELDS]
    keep = others(docs.select(*keep) if keep else docs, names)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("i"), F.lit(blocks))
    # rows travel as one column, so no name of theirs meets another; a text is known by 128 bits
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    out = docs.select(row.alias("row"), F.col(text).alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))
    index_of = lambda b: Index([tuple(r) for r in items.where(block == b).collect()], span, k)  # noqa: E731 one block, of about block_bytes, whose size was checked above
    earlier = []
    for b in range(blocks - 1):
        # hits alone are kept of a pass, once for each text that has some
        index = docs.sparkSession.sparkContext.broadcast(index_of(b))
        hits = map_texts(out.where("text is not null"), "text", ["a", "b"], FIELDS, lambda index=index: _kernel(index.value)).where(F.size("hit_items") > 0)
        earlier.append(saved(hits.select("a", "b", "hit_spans", "hit_items")))
        index.destroy()
    index = docs.sparkSession.sparkContext.broadcast(index_of(blocks - 1))
    if not earlier:
        return map_texts(out, "text", ["row"], FIELDS, lambda: _kernel(index.value)).select(*[F.col("row")[c].alias(c) for c in keep], *names)
    both = reduce(DataFrame.unionByName, earlier).dropDuplicates().groupBy("a", "b").agg(F.flatten(F.collect_list("hit_spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("i"))
    both = small(saved(both), F.size("s") * 16 + F.size("i") * 24 + 32, block_bytes)
    out = map_texts(out.join(both, ["a", "b"], "left"), "text", ["row", "s", "i"], FIELDS, lambda: _kernel(index.value))
    none = F.array()
    spans, items_ = F.coalesce("s", none.cast(T.ArrayType(SPAN))), F.coalesce("i", none.cast("array<string>"))
    out = out.withColumn("hit_spans", _merge_spans("hit_spans", spans)).withColumn("hit_items", F.array_sort(F.array_union("hit_items", items_)))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *names)
