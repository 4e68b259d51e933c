"""Source divergence audit: which sources of a language use its terms unlike the others.

Counting. A task turns the words of its texts into integers (a dictionary of
the terms it has met), counts pairs of document and term by sorting integers,
and pairs of group and term with one bincount; what leaves it is one row for
each group and term, with occurrences and documents. Spark adds these up by
language and term and keeps the terms of at least `least_documents` documents.

Shares. Kept terms are dealt out to chunks of a language, of about CELLS counts
each. A chunk meets the language's groups in a cogroup, so no dictionary is
broadcast or held whole. It sorts its terms; a term's id is its place there,
found by searchsorted, so ids are in UTF-8 order and equal values are in the
right order as they stand. Counts become a dense matrix of groups and terms,
with the language as its last row, and shares and divergences are integer
arithmetic on whole rows of it. Sums of pairs and the first terms of chunks are
merged by Spark.

With c occurrences of a kept term in a group, N of all kept terms there and V
kept terms, the share is p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and the
divergence of shares p and q is floor((p - q)^2 / (p + q)).

Nulls and odd input: null text, language and source count as ''; a text may
have no terms, and its group exists all the same; texts of any length are read
whole, a bounded part at a time; rows that repeat a document count as documents
of their own; ties go to the smaller item in UTF-8 order; a language without
kept terms has pairs of value 0 and no terms; an empty table gives an empty
result. Only the columns named are read, so others, whatever their names, are
left out. Shares are exact while N + 2 V is below 9 * 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows, partitions, saved, small
from tessera.llm.text import LETTERS, LOWER, PIECE, Words, cut_words, pieces, rows

CELLS = 1 << 18  # counts of a chunk
DENSE = 1 << 22  # counters of a piece
FLUSH = 400_000  # rows that a task holds before it sends them
RAW = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"
_LOW = np.frombuffer(LOWER, np.uint8)


class Terms:
    """A dictionary of the terms that a task has met."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words = Words(LETTERS)

    def ids(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the terms in data, which has texts' ends at cuts, and where they start."""
        starts, ends, _ = self.words.split(data, cuts)
        if not len(starts):
            return np.zeros(0, np.int64), starts
        at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        flat = _LOW[data[LETTERS[data]]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
        known = np.array([self.number.setdefault(w, len(self.number)) for w in words.dictionary.to_pylist()], np.int64)
        return known[words.indices.to_numpy()], starts


def summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and each column's sums over them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns)]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Occurrences and documents of each (language, source, term), as often as FLUSH rows have gathered."""
    terms, groups, held = Terms(), {}, []

    def flush() -> Iterator[dict]:
        nonlocal terms, groups, held
        if held:
            key, n, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            key, n, docs = summed(key, n, docs)
            names, words = list(groups), pa.array(list(terms.number), pa.binary()).cast(pa.string())
            for lo in range(0, len(key), 100_000):
                part = key[lo : lo + 100_000]
                own = [names[g] for g in (part >> 32).tolist()]
                yield {"lang": [a for a, _ in own], "source": [b for _, b in own], "term": words.take(pa.array(part & 0xFFFFFFFF)), "n": n[lo : lo + 100_000], "docs": docs[lo : lo + 100_000]}
        terms, groups, held = Terms(), {}, []

    waiting = 0
    for batch in batches:
        text = batch.column("text")
        names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        for lo, hi in pieces(text):
            group = np.array([groups.setdefault(x, len(groups)) for x in names[lo:hi]], np.int64)
            data, at = rows(text.slice(lo, hi - lo))
            found = []
            for a, b in cut_words(data, LETTERS, PIECE):
                ids, starts = terms.ids(data[a:b], at - a)
                doc = np.searchsorted(at, starts + a, "right") - 1
                pair, n = np.unique(doc << 32 | ids, return_counts=True)
                found.append((pair, n))
            if len(found) != 1:  # a text of several parts
                found = [tuple(summed(*(np.concatenate(x) for x in zip(*found, strict=True))))] if found else []
            for pair, n in found:
                # counts of group and term by number in the piece
                used, own = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
                here, which = np.unique(group[pair >> 32], return_inverse=True)
                cell, size = which * len(used) + own, len(used) * len(here)
                if size <= DENSE:
                    docs, total = np.bincount(cell, minlength=size), np.bincount(cell, weights=n, minlength=size)
                    cell = np.flatnonzero(docs)
                    docs, total = docs[cell], total[cell].astype(np.int64)
                else:  # very many groups
                    cell, total, docs = summed(cell, n, np.ones(len(n), np.int64))
                if len(cell):
                    held.append((here[cell // len(used)] << 32 | used[cell % len(used)], total, docs))
                    waiting += len(cell)
            if waiting > 4 * FLUSH or len(terms.number) > FLUSH:
                held = [tuple(summed(*(np.concatenate(x) for x in zip(*held, strict=True))))] if held else []
                waiting = len(held[0][0]) if held else 0
                if waiting > FLUSH or len(terms.number) > FLUSH:
                    yield from flush()
                    waiting = 0
    yield from flush()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), by long division in base 1000, for totals that are at least count + 2."""
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def divergence_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _chunk(top: int):
    """Pair sums and first terms of a chunk of a language's kept terms."""

    def run(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        order = np.argsort(np.array(groups.column("source").to_pylist(), object))
        sources = np.array(groups.column("source").to_pylist(), object)[order]
        size = np.asarray(groups.column("n"))[order]
        names = np.array([t.encode() for t in terms.column("term").to_pylist()], object)
        sorted_names = np.sort(names)
        ids, per = np.searchsorted(sorted_names, names), terms.column("per").combine_chunks()
        flat = per.flatten()
        row = np.repeat(ids, np.diff(np.asarray(per.offsets)))
        counts = np.zeros((len(sources) + 1, len(names)), np.int64)
        counts[np.searchsorted(sources, np.array(flat.field("source").to_pylist(), object)), row] = np.asarray(flat.field("n"))
        counts[-1] = counts[:-1].sum(axis=0)
        of_language = groups.column("of_language")[0].as_py()
        p = shares(counts, np.append(size, of_language)[:, None] + 2 * groups.column("kept")[0].as_py())
        out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

        def add(source: str, part: str, items: list[str], values: np.ndarray) -> None:
            for name, what in (("source", [source] * len(items)), ("part", [part] * len(items)), ("item", items), ("value", values.tolist())):
                out[name] += what

        for g, source in enumerate(sources):
            others = np.arange(len(sources)) != g
            add(source, "pair", sources[others].tolist(), divergence_of(p[:-1][others], p[g]).sum(axis=1))
            over = np.flatnonzero((counts[g] > 0) & (p[g] > p[-1]))
            value = divergence_of(p[g, over], p[-1, over])
            first = np.argsort(-value, kind="stable")[:top]  # ids ascend, so ties are in order
            add(source, "term", [sorted_names[i].decode() for i in over[first]], value[first])
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out["value"]), pa.string()), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})

    return run


def source_divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence from every other source of its language, and the terms that set it apart most."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    spark = docs.sparkSession
    raw = map_rows(plain, RAW, count_terms).repartition(partitions(spark, 0), "lang", "term")
    per = raw.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = per.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("per")).where(F.col("docs") >= least_documents)
    kept = saved(kept.drop("docs"))

    # groups with their totals, and the totals of their languages
    own = kept.select("lang", F.explode("per").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    terms = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    of_language = groups.groupBy("lang").agg(F.sum("n").alias("of_language"), F.count("*").alias("sources"))
    languages = of_language.join(terms, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    languages = saved(languages.withColumn("chunks", F.ceil(F.col("kept") * (F.col("sources") + 1) / CELLS).cast("int")))
    groups = saved(groups.join(small(languages, 64), "lang"))

    dealt = kept.join(small(languages.select("lang", "chunks"), 64), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    meets = groups.where("kept > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt, meets = dealt.select("lang", "chunk", "term", "per"), meets.select("lang", "chunk", "source", "n", "of_language", "kept")
    found = saved(dealt.groupBy("lang", "chunk").cogroup(meets.groupBy("lang", "chunk")).applyInArrow(_chunk(top), FOUND))

    alone = groups.where("kept = 0").select("lang", "source")
    nothing = alone.join(alone.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(nothing)
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by)
    first = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(first).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
