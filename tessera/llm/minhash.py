"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketches. A text's set holds its distinct k-word shingles, hashed to 64 bits.
Its sketch has t coordinates, filled in rounds. In round i < t every shingle is
thrown into a coordinate drawn by a hash of its own round, with a value of i
and a random fraction; in round t + j every shingle is thrown into coordinate j.
A coordinate keeps its least value, and a set is done once all are filled. Sets
of many shingles are done after one round, and whatever the size every
coordinate is filled after 2 t rounds at most. Two sets agree in a coordinate
with the probability of their similarity, with bounds on the concentration like
those of independent hashes, for about |set| + t log t hashes instead of t |set|.
Several rounds are thrown at once; earlier rounds win, so this changes nothing.

Banding. Bands of `rows` coordinates are hashed to one key each. The number of
bands is chosen so that two sets of the least similarity share none with a
probability of at most `miss`; more similar sets are missed less often.

Verification. Texts with equal sets are one node, known by a 128-bit sum of the
set, before anything is paired. A key of two nodes is a pair. A key of more
links each of its nodes with one leader, which is linear; a node is compared
with the leader that it shares most keys with, then with its others as far as
they are still in another component. Keys that then still hold several
components are settled whole, those with the same largest component at once, as
near copies share most of their keys: their nodes' sets meet in pairs of blocks of
bounded bytes, and only links that join components leave a block. Every link
that counts is confirmed on whole sets, and none between components is left
out that shares a key.

Nulls and odd input: null, empty and blank texts have an empty set and are
alone; texts of fewer than k words have their word sequence as one shingle;
rows that repeat an id with other text are nodes of their own, and are kept or
not by their id; null ids count as no id when a group's smallest is taken, and
whether they are kept is null; ids are integers, and text that is no number
counts as a null id; texts of any length are read whole; an empty table gives
an empty result. Only the id and the text are read, so other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.jaccard import Shingler, apart, components, hot_links, node_of, verify
from tessera.llm.shared import map_texts, partitions, saved, small, spent
from tessera.llm.text import mix

THROWN = 1 << 16  # shingles thrown at once
EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)


def bands_for(percent: int, rows: int, miss: float) -> int:
    """How many bands of `rows` coordinates miss a pair of the least similarity with a probability of at most `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))))


def sketches(sets: list[np.ndarray], t: int, seed: int = 7) -> np.ndarray:
    """One row of t coordinates for each set; those of an empty set stay EMPTY."""
    out = np.full(len(sets) * t, EMPTY)
    sizes = np.array([len(s) for s in sets])
    live = np.flatnonzero(sizes)
    rounds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    i = 0
    while len(live) and i < 2 * t:
        tokens = np.concatenate([sets[s] for s in live])
        base = np.repeat(live * t, sizes[live])
        while i < 2 * t:
            n = int(min(max(1, THROWN // len(tokens)), (t if i < t else 2 * t) - i))
            h = mix(tokens ^ rounds[i : i + n, None])
            number = np.arange(i, i + n, dtype=np.uint64)[:, None]
            place = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if i < t else np.broadcast_to(number - np.uint64(t), h.shape)
            np.minimum.at(out, (base + place.astype(np.int64)).ravel(), (number << np.uint64(32) | h & _LOW).ravel())
            i += n
            left = live[(out.reshape(-1, t)[live] == EMPTY).any(axis=1)]
            if sizes[left].sum() < 0.7 * len(tokens):
                break
        live = live[(out.reshape(-1, t)[live] == EMPTY).any(axis=1)]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bands = sketch.shape[1] // rows
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sketch[:, r : bands * rows : rows])
    return key.view(np.int64)


def _measure(k: int, rows: int, bands: int):
    def make():
        shingler = Shingler(k)

        def run(column: pa.Array) -> list[pa.Array]:
            sets = shingler.sets(column)
            nodes = [node_of(s) for s in sets]
            first = {node: i for i, node in reversed(list(enumerate(nodes))) if len(sets[i])}  # copies are sketched once
            some = sorted(first.values())
            keys = band_keys(sketches([sets[i] for i in some], rows * bands), rows)
            here = np.zeros(len(sets) + 1, np.int32)
            here[np.array(some, np.int64) + 1] = bands
            has = np.zeros(len(sets), bool)
            has[some] = True
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(here, dtype=np.int32)), pa.array(keys.ravel()), mask=pa.array(~has))
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), lists]

        return run

    return make


def near_duplicates_by_sketch(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 2, percent: int = 80, rows: int = 6, miss: float = 1e-8) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links) and kept (whether the id is that)."""
    spark, bands = docs.sparkSession, bands_for(percent, rows, miss)
    own = F.col(doc_id).try_cast("long")
    source = docs.select(own.alias(doc_id), F.coalesce(own, F.lit(-(2**63))).alias("__key"), F.col(text).alias(text))
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    members = saved(map_texts(source, text, [doc_id, "__key"], fields, _measure(k, rows, bands)))
    sketched = members.where("bands is not null").groupBy("node").agg(F.min("__key").alias("key"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    nodes = saved(sketched)
    keys = nodes.select("node", "key")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = partitions(spark, 8 * total)

    # keys that several nodes share: two make a pair, more a list
    posting = nodes.select(F.explode("bands").alias("tok"), F.struct("node", "n").alias("x"))
    met = posting.groupBy("tok").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("size")).where("size > 1")
    met = saved(met)
    lists = met.where("size > 2").select("tok", F.col("lo").alias("lead"), "size")
    entry = saved(posting.join(small(lists, 48), "tok").select("tok", "lead", F.col("x.node").alias("node"), F.col("x.n").alias("n"), "size"))
    near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    twos = met.where("size = 2").where(near(F.col("lo.n"), F.col("hi.n"))).select(F.col("lo.node").alias("a"), F.col("hi.node").alias("b"))
    led = entry.where("node <> lead.node").where(near(F.col("n"), F.col("lead.n"))).select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
    pairs = saved(twos.unionByName(led).groupBy("a", "b").agg(F.count("*").alias("c")))
    spent(met)

    linked: list[DataFrame] = []
    known: list[DataFrame] = []  # the components so far

    def join_in(links: DataFrame) -> DataFrame:
        linked.append(links)
        known.append(components(reduce(DataFrame.unionByName, linked)))
        return known[-1].select("node", "root")

    def link(some: DataFrame) -> DataFrame:
        return join_in(verify(source, keys, some, text, k, percent, parts))

    best = saved(pairs.groupBy("b").agg(F.max(F.struct("c", "a")).alias("x")).select("x.a", "b"))
    roots = link(best)
    rest = saved(apart(pairs.select("a", "b").join(small(best, 48), ["a", "b"], "left_anti"), roots).select("a", "b"))
    if not rest.isEmpty():
        roots = link(rest)
    spent(pairs, best, rest)

    # lists that hold several components
    entry_roots = entry.select("tok", "node", "n", F.lit(0).alias("place")).join(small(roots, 64), "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = saved(entry_roots)
    mixed = saved(held.groupBy("tok").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("tok"))
    if not mixed.isEmpty():
        roots = join_in(hot_links(source, keys, held, mixed, text, k, percent, parts))
    spent(entry, held, mixed)

    grouped = members.where("n_shingles > 0").select(doc_id, "n_shingles", "node").join(small(roots, 64), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = small(saved(grouped.groupBy("root").agg(F.min(doc_id).alias("component_id"))), 48)
    linked_rows = grouped.join(smallest, "root").select(doc_id, "n_shingles", "component_id")
    every = linked_rows.unionByName(members.where("n_shingles = 0").select(doc_id, "n_shingles", F.col(doc_id).alias("component_id")))
    spent(nodes, *linked, *known[:-1])
    return every.withColumn("kept", F.col(doc_id) == F.col("component_id"))
