"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A text's set holds its distinct k-word shingles, hashed to 64 bits. Texts with
equal sets are one node from the start, known by a 128-bit sum of the set, so
copies cost one row each and are never paired.

Order. All sets are sorted in one global order: rare shingles first, by hash,
then frequent ones, rarest first. Frequencies are counted over all texts by
range tasks that get hashes in blobs; the frequent ones go to all tasks, at
most `most_frequent` of them (those with the highest counts; the order decides
what the join costs and never what it finds).

Prefixes. Two sets of Jaccard t share at least ceil(t * n) shingles for either
size n, so their prefixes of n - ceil(t * n) + l shingles share at least l.
Each text picks its own l from {1, 2, 3, ...} by estimated cost: the postings
that its prefix meets, and the candidates that can share l of them. Longer
prefixes and closer sizes let a pair demand more shared shingles, and demand
them further to the front: level_of has the rule, and a pair that shares fewer
is not verified.

Join. Prefix postings are dealt out by shingle range, in blobs; a list of more
than SPLIT postings, known from the counts, is dealt out to several ranges by
node, so no task reads more than a part of it. A first round
links each posting only with two leaders of its list, which is linear in the
postings. Each node is verified on whole sets with the leader that it shares
most with, then with its other leaders as far as they are still in another
component. The rounds that follow complete the join on the posting lists that
hold more than one component; links within a component are never looked for.

Lists of more than HOT postings, as of a large group of near copies that are not
all similar, would give the square of their size in candidates. They are
verified where they are: the first shared shingle of two similar sets lies in
both of their shortest prefixes, so of a hot list only those postings count, and
whole sets meet in pairs of blocks of bounded bytes, once for all lists with one largest component. A task multiplies the
blocks' membership matrices and gives only links that join two components, a
forest of them, so its output grows with the nodes and not with their pairs.

Other lists give pairs of members of different components, summed over lists. A
pair is a candidate if it may share enough: what it shares in these lists, and
what it could share at most in hot ones. Nodes with fewer postings in such lists
than a pair must share give no pair at all. Candidates are verified as before,
the best pair of each two components first. Components are those of all links.
near_duplicate_links has the links themselves.

Verification sends each needed set once for each leader; leaders of many are
salted. Components of few links come from one task, those of many from repeated
minimum and pointer jumping, each iteration a table in the shared folder.

Nulls and odd input: null, empty and blank texts have an empty set and are
alone; texts of fewer than k words have their whole word sequence as one
shingle; rows that repeat an id with other text are nodes of their own; null
ids count as no id when a group's smallest id is taken; ids are integers, and
text that is no number counts as a null id; texts of any length are read whole; an
empty table gives an empty result. Only the id and the text are read, so other
columns, whatever their names, are left out and can't clash. Intermediate tables
are deleted as soon as nothing reads them any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import give_back, map_rows, map_texts, partitions, saved, small, spent
from tessera.llm.text import NOT_SPACE, Words, grams, mix, pieces, rows

LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64])
VERIFY = 20.0  # cost of a candidate, in postings
FLUSH = 250_000  # entries that a task holds before it sends them
TEXTS = 1 << 20  # bytes of text that are shingled at once
FEW = 200_000  # edges whose components one task finds
SEND = 2 << 20  # bytes of sets that are sent at once
SPLIT = 20_000  # postings of a list that one task reads, about
SALTED = np.uint64(1 << 62)  # marks keys of lists that are dealt out to several tasks
HOT = 100  # postings of a list whose pairs are verified in blocks
BLOCK_BYTES = 1 << 20  # of sets in a block
ENTRIES = 50_000  # entries of posting lists that are looked at at once
PAIRS = 500_000  # pairs that are counted at once
_ODD = np.uint64(0xD6E8FEB86659FD93)
NODE = np.dtype("V16")


class Shingler:
    def __init__(self, k: int) -> None:
        self.k, self.words = k, Words(NOT_SPACE, seed=3)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        data, at = rows(column)
        starts, ends, before = self.words.split(data, at)
        h = self.words.hashes(data, starts, ends)
        g, out = grams(h, self.k), []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            own = g[a : b - self.k + 1] if b - a >= self.k else grams(h[a:b], b - a) if b > a else g[:0]
            own = np.sort(own)
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
        return out


def node_of(tokens: np.ndarray) -> bytes:
    one = mix(np.append(tokens ^ _ODD, np.uint64(len(tokens)))).sum(dtype=np.uint64)
    two = mix(tokens * _ODD + np.uint64(1)).sum(dtype=np.uint64)
    return np.array([one, two], ">u8").tobytes()


def least_shared(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(percent / 100 * n)"""
    return (n * percent + 99) // 100


def _where(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Range number (high half) and 32 bits of each token (low half)."""
    high = ((tokens * _ODD) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return high << np.uint64(32) | tokens & np.uint64(0xFFFFFFFF)


def _texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Array]:
    for batch in batches:
        column = batch.column(text)
        for lo, hi in pieces(column, TEXTS):
            yield column.slice(lo, hi - lo)


def _by_range(where: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted entries."""
    r = where >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=True):
        yield int(r[a]), a, b


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs by range; rows come sorted by range."""
    last, own = None, []
    for batch in batches:
        for r, blob in zip(batch.column("r").to_pylist(), batch.column("blob"), strict=True):
            if r != last and own:
                yield last, own
                own = []
            last = r
            own.append(blob.as_py())
    if own:
        yield last, own


class Frequent:
    """Frequent shingles, by range and 32 bits, with their counts."""

    def __init__(self, where: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(where)
        self.where, self.count = where[order], count[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.where & np.uint64((1 << 22) - 1)] = True

    def counts(self, where: np.ndarray) -> np.ndarray:
        """The count of each entry, 1 where it isn't frequent."""
        out = np.ones(len(where), np.int64)
        some = np.flatnonzero(self.bits[where & np.uint64((1 << 22) - 1)])
        if len(some):
            at = np.minimum(np.searchsorted(self.where, where[some]), len(self.where) - 1)
            hit = self.where[at] == where[some]
            out[some[hit]] = self.count[at[hit]]
        return out


def count_frequent(docs: DataFrame, text: str, k: int, ranges: int, parts: int, least: int, most: int) -> Frequent:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingler, wait, waiting = Shingler(k), [], 0

        def flush() -> dict:
            where = np.sort(_where(np.concatenate(wait), ranges))
            wait.clear()
            low = where.astype(np.uint32)
            found = [(r, low[a:b].tobytes()) for r, a, b in _by_range(where)]
            return {"r": [r for r, _ in found], "blob": [b for _, b in found]}

        for column in _texts(batches, text):
            for tokens in {node_of(s): s for s in shingler.sets(column) if len(s)}.values():
                wait.append(tokens)
                waiting += len(tokens)
                if waiting > FLUSH:
                    yield flush()
                    waiting = 0
        if wait:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r, blobs in _groups(batches):
            low, count = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in blobs]), return_counts=True)
            hot = count >= least
            if hot.any():
                yield {"w": (np.int64(r) << 32) + low[hot].astype(np.int64), "c": count[hot]}

    blobs = map_rows(docs.select(text), "r int, blob binary", spread)
    hot = map_rows(blobs.repartition(parts, "r").sortWithinPartitions("r"), "w long, c long", gather)
    kept = saved(hot.orderBy(F.desc("c"), "w").limit(most))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"w": [np.asarray(batch.column("w")).tobytes()], "c": [np.asarray(batch.column("c")).tobytes()]}

    # as blobs, a part at a time: the driver holds the arrays once, and Spark's side of it a part of them
    w, c = [], []
    for row in map_rows(kept.repartition(16), "w binary, c binary", packed).toLocalIterator():
        w.append(np.frombuffer(row.w, np.uint64))
        c.append(np.frombuffer(row.c, np.int64))
    frequent = Frequent(np.concatenate([np.zeros(0, np.uint64), *w]), np.concatenate([np.zeros(0, np.int64), *c]))
    del w, c
    spent(kept)
    give_back()
    return frequent


def prefix(tokens: np.ndarray, frequent: Frequent, ranges: int, percent: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Entries of a set's prefix, its l, and the counts of the entries."""
    n, where = len(tokens), _where(tokens, ranges)
    count = frequent.counts(where)
    if (count > 1).any():
        order = np.argsort(count, kind="stable")  # rare ones by hash, then frequent ones by count and hash
        where, count = where[order], count[order]
    one = int(n - least_shared(n, percent) + 1)
    if count[one - 1] == 1:
        return where[:one], 1, count[:one]
    levels = LEVELS[one - 1 + LEVELS <= n]
    met = np.cumsum(count)[one - 2 + levels]
    level = int(levels[np.argmin(met * (1 + VERIFY / levels))])
    return where[: one - 1 + level], level, count[: one - 1 + level]


def _dealt(where: np.ndarray, count: np.ndarray, node: bytes, ranges: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """The range that each entry goes to and, as home and salted bit, where its list belongs.

    A list of more than `split` postings goes to as many ranges as it needs, by node.
    """
    home = where >> np.uint64(32)
    if not (count > split).any():
        return home, home << np.uint64(1)
    salts = np.maximum(1, -(-count // split)).astype(np.uint64)
    salt = np.uint64(int.from_bytes(node[:8], "big")) % salts
    return (home + salt) % np.uint64(ranges), home << np.uint64(1) | (salts > 1)


def postings(docs: DataFrame, text: str, k: int, ranges: int, percent: int, frequent, split: int) -> DataFrame:
    """Blobs of prefix entries by range: nodes with sizes and levels, then entries."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingler, known = Shingler(k), frequent.value
        fresh = lambda: {"seen": {}, "where": [], "range": [], "home": [], "n": [], "level": [], "waiting": 0}
        state: dict = fresh()

        def flush() -> Iterator[dict]:
            sizes = [len(w) for w in state["where"]]
            low, doc = np.concatenate(state["where"]).astype(np.uint32), np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(low)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
            to, home = np.concatenate(state["range"]), np.concatenate(state["home"])
            order = np.lexsort((low, home, to))
            low, doc, place, to, home = low[order], doc[order], place[order].astype(np.int32), to[order], home[order]
            nodes = np.frombuffer(b"".join(state["seen"]), NODE)
            n, level = np.array(state["n"], np.int32), np.array(state["level"], np.int32)
            cuts = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (home[1:] != home[:-1]))))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True):
                here, own = np.unique(doc[a:b], return_inverse=True)
                head = np.array([len(here), b - a, home[a] >> np.uint64(1), home[a] & np.uint64(1)], np.int32).tobytes()
                yield {"r": [int(to[a])], "blob": [head + nodes[here].tobytes() + n[here].tobytes() + level[here].tobytes() + low[a:b].tobytes() + own.astype(np.uint32).tobytes() + place[a:b].tobytes()]}

        for column in _texts(batches, text):
            for tokens in shingler.sets(column):
                if len(tokens) and (node := node_of(tokens)) not in state["seen"]:
                    entries, level, count = prefix(tokens, known, ranges, percent)
                    to, home = _dealt(entries, count, node, ranges, split)
                    state["seen"][node] = None
                    state["where"].append(entries)
                    state["range"].append(to)
                    state["home"].append(home)
                    state["n"].append(len(tokens))
                    state["level"].append(level)
                    state["waiting"] += len(entries)
                    if state["waiting"] > FLUSH:
                        yield from flush()
                        state = fresh()
        if state["waiting"]:
            yield from flush()

    return map_rows(docs.select(text), "r int, blob binary", spread)


FOUND = "kind int, tok long, a binary, b binary, na int, nb int, la int, lb int, c int"


def _unblob(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Nodes (distinct), sizes, levels; and keys (of the lists, see SALTED), node numbers and places in their prefixes of entries."""
    nodes, n, level, key, doc, place, at = [], [], [], [], [], [], 0
    for blob in blobs:
        d, e, home, salted = np.frombuffer(blob, np.int32, 4)
        p = 16
        for out, kind, m in ((nodes, NODE, d), (n, np.int32, d), (level, np.int32, d), (key, np.uint32, e), (doc, np.uint32, e), (place, np.int32, e)):
            out.append(np.frombuffer(blob, kind, m, p))
            p += int(m) * kind.itemsize if isinstance(kind, np.dtype) else int(m) * np.dtype(kind).itemsize
        doc[-1] = doc[-1].astype(np.int64) + at
        key[-1] = key[-1].astype(np.uint64) | np.uint64(int(home)) << np.uint64(32) | (SALTED if salted else np.uint64(0))
        at += int(d)
    all_nodes = np.concatenate(nodes)
    pair = np.frombuffer(all_nodes.tobytes(), ">u8").reshape(-1, 2)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    new = np.concatenate(([True], (pair[order][1:] != pair[order][:-1]).any(axis=1)))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return all_nodes[first], np.concatenate(n)[first], np.concatenate(level)[first], np.concatenate(key), number[np.concatenate(doc)], np.concatenate(place)


def level_of(na, nb, la, lb, percent: int):
    """For pairs of sets: how many shared shingles make a candidate, and the least overlap of similar ones.

    Of two sets that share at least `least`, the first `level` shared shingles
    have places below n - least + level in either order, and level is chosen
    so that these places lie in both prefixes.
    """
    least = -(-percent * (na + nb) // (100 + percent))
    room = np.minimum(la + least - least_shared(na, percent), lb + least - least_shared(nb, percent))
    return np.minimum(1 + np.minimum(na, nb) // 10, room), least


def _two(nodes, n, level, doc, place, at, percent):
    """Pairs of lists of two that are near enough in size and place."""
    a, b = at, at + 1
    swap = n[doc[a]] > n[doc[b]]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    x, y = doc[a], doc[b]
    need, least = level_of(n[x].astype(np.int64), n[y].astype(np.int64), level[x], level[y], percent)
    near = (least_shared(n[y], percent) <= n[x]) & (place[a] < n[x] - least + need) & (place[b] < n[y] - least + need)
    return x[near], y[near]


def _links(percent: int):
    """From posting lists: pairs of lists of two (kind 2), leader pairs (kind 1), entries of longer lists (kind 0) and leaders of parts of lists (kind 3).

    Each list has two leaders, its first and its last node; as nodes are
    hashes, they are drawn at random and alike in all lists of a group. Those
    whose sizes rule a leader out get leaders of their own. Of a list that is
    dealt out to several tasks each has a part, whose leaders are linked with
    those of the whole list later on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, blobs in _groups(batches):
            nodes, n, level, key, doc, place = _unblob(blobs)
            order = np.lexsort((doc, key))
            key, doc, place = key[order], doc[order], place[order]
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            key, doc, place = key[fresh], doc[fresh], place[fresh]  # copies in several blobs
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(cuts, len(key)))
            part = (key[cuts] & SALTED) > 0
            pairs = {2: [_two(nodes, n, level, doc, place, cuts[(size == 2) & ~part], percent)], 1: []}
            entry, heads = [], np.unique(np.concatenate((cuts[part], (cuts + size - 1)[part])))
            long = (size > 2) | part
            for lo, m in zip(cuts[long].tolist(), size[long].tolist(), strict=True):
                entry.append(np.arange(lo, lo + m))
                for some in (entry[-1], entry[-1][::-1]):
                    while len(some) > 1:
                        own, size_ = doc[some], n[doc[some]].astype(np.int64)
                        near = least_shared(np.maximum(size_[0], size_), percent) <= np.minimum(size_[0], size_)
                        need, least = level_of(size_[0], size_, level[own[0]], level[own], percent)
                        counts = near & (place[some[0]] < size_[0] - least + need) & (place[some] < size_ - least + need)
                        counts[0] = False
                        if counts.any():
                            pairs[1].append((np.full(int(counts.sum()), own[0]), own[counts]))
                        some = some[1:][~near[1:]]
            for kind, found in pairs.items():
                if found:
                    code, c = np.unique(np.concatenate([x.astype(np.int64) * len(nodes) + y for x, y in found]), return_counts=True)
                    x, y = code // len(nodes), code % len(nodes)
                    for lo in range(0, len(code), 50_000):
                        u, v = x[lo : lo + 50_000], y[lo : lo + 50_000]
                        yield {"kind": np.full(len(u), kind), "tok": np.zeros(len(u), np.int64), "a": nodes[u].tolist(), "b": nodes[v].tolist(), "na": n[u], "nb": n[v], "la": level[u], "lb": level[v], "c": c[lo : lo + 50_000]}
            for kind, at in ((0, np.concatenate(entry) if entry else heads), (3, heads)):
                for lo in range(0, len(at), 50_000):
                    e = at[lo : lo + 50_000]
                    d, none = doc[e], np.zeros(len(e), np.int32)
                    yield {"kind": none + kind, "tok": (key[e] & ~SALTED).astype(np.int64), "a": nodes[d].tolist(), "b": [None] * len(e), "na": n[d], "nb": none, "la": level[d], "lb": none, "c": place[e]}

    return run


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 16-byte values, and each row's number among them."""
    flat = np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.concatenate(([True], (flat[order][1:] != flat[order][:-1]).any(axis=1)))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return np.frombuffer(flat[order[new]].tobytes(), NODE), number


def _across(percent: int):
    """Counts of shared shingles for pairs of different components, from the entries of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in _whole_groups(batches):
            yield from pairs(table)

    def pairs(table: pa.Table) -> Iterator[dict]:
        nodes, doc = _numbered(table.column("node"))
        root = _numbered(table.column("root"))[1]
        tok, n, level, place, k, hot = (np.asarray(table.column(c)).astype(np.int64) for c in ("tok", "n", "l", "place", "k", "hot"))
        order = np.lexsort((n, tok))
        doc, root, tok, n, level, place, k, hot = (v[order] for v in (doc, root, tok, n, level, place, k, hot))
        size, high, other = (np.zeros(len(nodes), np.int64) for _ in range(3))
        size[doc], high[doc], other[doc] = n, level, hot
        cuts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        # the smaller of a pair has the place of at least one counted shingle below this
        limit = n - -(-2 * percent * n // (100 + percent)) + 1 + n // 10
        found: list[np.ndarray] = []

        def flush() -> Iterator[dict]:
            code, c = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            for lo in range(0, len(code), 50_000):
                u, v = code[lo : lo + 50_000] // len(nodes), code[lo : lo + 50_000] % len(nodes)
                yield {"a": nodes[u].tolist(), "b": nodes[v].tolist(), "need": level_of(size[u], size[v], high[u], high[v], percent)[0] - np.minimum(other[u], other[v]), "c": c[lo : lo + 50_000]}

        waiting = 0
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tok)], strict=True):
            if waiting > PAIRS:
                yield from flush()
                waiting = 0
            for i in (lo + np.flatnonzero(place[lo:hi] < limit[lo:hi])).tolist():
                # equal sizes meet once: the later entry is the larger
                j = np.arange(i + 1, lo + int(np.searchsorted(n[lo:hi], n[i] * 100 // percent, "right")))
                j = j[root[j] != root[i]]
                if len(j):
                    need, least = level_of(n[i], n[j], level[i], level[j], percent)
                    j = j[(place[i] < n[i] - least + need) & (place[j] < n[j] - least + need) & (np.minimum(k[i], k[j]) >= need)]
                    if len(j):
                        found.append(np.minimum(doc[i], doc[j]) * len(nodes) + np.maximum(doc[i], doc[j]))
                        waiting += len(j)
        if found:
            yield from flush()

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by tok in tables of whole lists, each of about ENTRIES rows or of one list."""
    wait: list[pa.RecordBatch] = []
    for batch in batches:
        tok = np.asarray(batch.column("tok"))
        cuts = (np.flatnonzero(tok[1:] != tok[:-1]) + 1).tolist()
        if wait and wait[-1].column("tok")[-1].as_py() != tok[0]:
            cuts.insert(0, 0)
        at = 0
        for cut in cuts:
            if sum(b.num_rows for b in wait) + cut - at >= ENTRIES:
                yield pa.Table.from_batches([*wait, batch.slice(at, cut - at)])
                wait, at = [], cut
        if batch.num_rows > at:
            wait.append(batch.slice(at))
    if wait:
        yield pa.Table.from_batches(wait)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b, by products of membership matrices."""
    every = np.concatenate([*a, *b])
    values, count = np.unique(every, return_counts=True)
    values = values[count > 1]  # others are in one set only
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(64, (8 << 20) // (4 * max(1, len(a) + len(b))))  # columns in 8 MB
    for lo in range(0, len(values), width):
        part = values[lo : lo + width]
        sides = []
        for flat, row, n in ((flat_a, rows_a, len(a)), (flat_b, rows_b, len(b))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            side = np.zeros((n, len(part)), np.float32)
            side[row[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _blocks(percent: int):
    """Links that join components, a forest of them, of each pair of blocks (unit, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        stream = ((key, row) for batch in batches for key, row in zip(zip(*(batch.column(c).to_pylist() for c in ("unit", "x", "y")), strict=True), zip(*(batch.column(c) for c in ("own", "node", "root", "tokens")), strict=True), strict=True))
        for (_, x, y), group in groupby(stream, key=lambda r: r[0]):
            sides = {x: [], y: []}
            for _, (own, node, root, tokens) in group:
                sides[own.as_py()].append((node.as_py(), root.as_py(), np.frombuffer(tokens.as_buffer(), np.uint64)))
            links = _forest(sides[x], sides[y], percent)
            if links:
                yield {"a": [a for a, _ in links], "b": [b for _, b in links]}

    return run


def _forest(first: list[tuple], second: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Similar pairs of (node, root, tokens) from two blocks, as many as connect their components."""
    if not first or not second:
        return []
    shared = _overlaps([t for _, _, t in first], [t for _, _, t in second])
    sizes = [np.array([len(t) for _, _, t in side]) for side in (first, second)]
    close = 100 * shared >= percent * (sizes[0][:, None] + sizes[1] - shared)
    number: dict[bytes, int] = {}
    roots = [np.array([number.setdefault(r, len(number)) for _, r, _ in side]) for side in (first, second)]
    close &= roots[0][:, None] != roots[1]
    above = list(range(len(number)))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(close)), strict=True):
        u, v = find(int(roots[0][i])), find(int(roots[1][j]))
        if u != v:
            above[u] = v
            links.append((first[i][0], second[j][0]))
    return links


def node_sets(docs: DataFrame, keys: DataFrame, nodes: DataFrame, text: str, k: int) -> DataFrame:
    """(node, tokens) of the given nodes, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingler = Shingler(k)
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), TEXTS):
                part = batch.slice(lo, hi - lo)
                found = [(node, s.tobytes()) for s, node in zip(shingler.sets(part.column("text")), part.column("node").to_pylist(), strict=True) if node_of(s) == node]
                if found:  # an id may come with several texts
                    yield dict(zip(("node", "tokens"), zip(*found, strict=True), strict=True))

    wanted = saved(nodes.join(keys, "node").select(F.col("key").alias("__key"), "node"))
    texts = docs.select(F.col("__key"), F.col(text).alias("text")).join(small(wanted, F.lit(40), 8 << 20), "__key").select("text", "node")
    sets = saved(map_rows(texts, "node binary, tokens binary", run).dropDuplicates(["node"]))
    spent(wanted)
    return sets


def units(member: DataFrame) -> DataFrame:
    """(unit, main, node, root, n): what is compared with each other, from members (tok, node, root, n) of lists that hold several components.

    A group of near copies shares nearly the same lists, so lists with the same
    largest component (main) are one unit, whose nodes come once however many
    lists they are in. Where that would compare more pairs than the lists do, each list stays a unit.
    """
    size = member.groupBy("tok", "root").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    lists = saved(size.groupBy("tok").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("m").alias("m")))
    of_main = member.join(small(lists.select("tok", "main"), 40), "tok")
    every = saved(of_main.select("main", "node", "root", "n").distinct())
    pairs = lists.groupBy("main").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    merged = saved(every.groupBy("main").agg(F.count("*").alias("m")).join(pairs, "main").where("m * m <= pairs").select("main"))
    together = every.join(small(merged, 32), "main").withColumn("unit", F.col("main"))
    alone = of_main.join(small(merged, 32), "main", "left_anti").withColumn("unit", F.unhex(F.hex("tok")))
    columns = ["unit", "main", "node", "root", "n"]
    out = saved(together.select(columns).unionByName(alone.select(columns)))
    spent(lists, every, merged)
    return out


def hot_links(docs: DataFrame, keys: DataFrame, entry: DataFrame, hot: DataFrame, text: str, k: int, percent: int, parts: int) -> DataFrame:
    """Links (a, b) between components among the members of hot lists.

    Members meet in blocks. Those of a unit's largest component are in blocks of their own,
    which are not paired with each other: only the others are sent to many.
    """
    least = F.floor((F.col("n") * percent + 99) / 100)
    near = entry.join(small(hot.select("tok"), 16), "tok").where(F.col("place") <= F.col("n") - least).select("tok", "node", "root", "n")
    mixed = saved(near.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok"))
    member = saved(near.join(small(mixed, 16), "tok"))
    sets = node_sets(docs, keys, member.select("node").distinct(), text, k)
    every = units(member)
    main = F.col("root") == F.col("main")
    blocks = lambda n: F.ceil(n * 8 / BLOCK_BYTES).cast("int")
    size = every.groupBy("unit").agg(F.sum("n").alias("n"), F.sum(F.when(main, F.col("n")).otherwise(0)).alias("most"))
    fits = blocks(F.col("n")) <= 1
    size = saved(size.select("unit", F.when(fits, 1).otherwise(blocks(F.col("n") - F.col("most"))).alias("others"), F.when(fits, 0).otherwise(blocks(F.col("most"))).alias("mains")))
    aside = main & (F.col("mains") > 0)
    number = F.pmod(F.xxhash64("node"), F.when(aside, F.col("mains")).otherwise(F.col("others"))).cast("int")
    split = every.join(small(size, 40), "unit").withColumn("own", number + F.when(aside, F.col("others")).otherwise(0))
    split = split.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(aside, 0).otherwise(F.col("mains")) - 1)))
    dealt = split.select("unit", F.least("own", "z").alias("x"), F.greatest("own", "z").alias("y"), "own", "node", "root").join(sets, "node")
    dealt = dealt.repartition(parts, "unit", "x", "y").sortWithinPartitions("unit", "x", "y")
    links = saved(map_rows(dealt.select("unit", "x", "y", "own", "node", "root", "tokens"), "a binary, b binary", _blocks(percent)))
    spent(mixed, member, sets, every, size)
    return links


def _send(k: int):
    shingler = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        nonlocal shingler
        shingler = shingler or Shingler(k)
        for batch in batches:
            for lo, hi in pieces(batch.column("text"), TEXTS):
                part = batch.slice(lo, hi - lo)
                out, size = [], 0
                for tokens, node, need in zip(shingler.sets(part.column("text")), part.column("node").to_pylist(), part.column("need").to_pylist(), strict=True):
                    if node_of(tokens) == node:  # an id may come with several texts
                        own = tokens.tobytes()
                        for x in need:
                            out.append((x["lead"], x["salt"], x["role"], node, own))
                            size += len(own)
                            if size > SEND:
                                yield dict(zip(("lead", "salt", "role", "node", "tokens"), zip(*out, strict=True), strict=True))
                                out, size = [], 0
                if out:
                    yield dict(zip(("lead", "salt", "role", "node", "tokens"), zip(*out, strict=True), strict=True))

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        lead, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for key, role, node, tokens in zip(*(batch.column(c).to_pylist() for c in ("lead", "role", "node", "tokens")), strict=True):
                tokens = np.frombuffer(tokens, np.uint64)
                if role == 0:
                    lead, own = key, tokens
                elif key == lead:
                    at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                    shared = int((own[at] == tokens).sum())
                    if 100 * shared >= percent * (len(own) + len(tokens) - shared):
                        a.append(key)
                        b.append(node)
            if a:
                yield {"a": a, "b": b}

    return run


def verify(docs: DataFrame, keys: DataFrame, pairs: DataFrame, text: str, k: int, percent: int, parts: int, group: int = 128, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough; repeated rows may repeat pairs. keys: node to the key of a row that has it."""
    n = pairs.count()
    few = n * 200 <= 8 << 20  # what nodes need: two nodes for each pair at most, some 100 bytes each
    pairs = F.broadcast(pairs) if n * 48 <= 8 << 20 else pairs
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("node"), F.struct(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")).alias("x"))
    leads = salts.select(F.col("a").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.col("a").alias("lead"), s.alias("salt"), F.lit(0).alias("role")))).alias("x"))
    need = members.unionByName(leads).groupBy("node").agg(F.collect_list("x").alias("need"))
    wanted = saved((F.broadcast(need) if few else need.hint("merge")).join(keys, "node").select(F.col("key").alias("__key"), "node", "need"))
    sent = docs.select(F.col("__key"), F.col(text).alias("text")).join(small(wanted, 64 + 100 * F.size("need"), broadcast_bytes), "__key").select("text", "node", "need")
    sets = map_rows(sent, "lead binary, salt int, role int, node binary, tokens binary", _send(k))
    dealt = sets.repartition(parts, "lead", "salt").sortWithinPartitions("lead", "salt", "role")
    links = saved(map_rows(dealt, "a binary, b binary", _compare(percent)))
    spent(wanted)
    return links


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Components of a bounded number of edges."""
    every = list(batches)
    if not sum(b.num_rows for b in every):
        return
    table = pa.Table.from_batches(every)
    nodes, number = _numbered(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]))
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(number[: len(table)].tolist(), number[len(table) :].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    yield {"node": nodes.tolist(), "root": nodes[[find(i) for i in range(len(nodes))]].tolist()}


def components(edges: DataFrame) -> DataFrame:
    """A saved table with (node, root) for every node of the edges: root is the smallest node it is connected with.

    Up to FEW edges, which one task holds with ease, are joined by union-find;
    beyond that labels are lowered and pointers followed by joins, round by round.
    """
    if edges.count() <= FEW:
        return saved(map_rows(edges.select("a", "b").coalesce(1), "node binary, root binary", _union))
    both = saved(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other").distinct())
    labels = saved(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    while True:
        reach = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        lower = labels.join(reach, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        lower = saved(lower)
        spent(labels)
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = saved(lower.join(jump, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("old")).alias("moved")))
        spent(lower)
        if labels.where("moved").isEmpty():
            spent(both)
            return labels


def level_column(percent: int) -> Column:
    """level_of for columns na, nb, la, lb."""
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    room = [F.col(x) + least - F.floor((F.col(n) * percent + 99) / 100) for n, x in (("na", "la"), ("nb", "lb"))]
    return F.least(F.floor(F.least("na", "nb") / 10) + 1, *room).cast("int")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in one component, with the roots of both."""
    pairs, roots = pairs.select(*[c for c in pairs.columns if not c.startswith("root_")]), small(roots, 64)
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a <> root_b")


def _prepared(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, least_frequent: int, most_frequent: int, range_tokens: int, split: int, carry: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int, bool]:
    """Texts with their keys, rows with sizes and nodes, pairs and entries found in posting lists, a key for each node; the number of partitions; and whether a list was dealt out to several."""
    spark = docs.sparkSession
    own = F.col(doc_id).try_cast("long")
    source = docs.select(own.alias(doc_id), F.coalesce(own, F.lit(-(2**63))).alias("__key"), F.col(text).alias(text), *carry)
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType())]

    def measure():
        shingler = Shingler(k)

        def run(column: pa.Array) -> list[pa.Array]:
            sets = shingler.sets(column)
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.binary())]

        return run

    members = saved(map_texts(source, text, [doc_id, "__key", *carry], fields, measure, TEXTS))
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    parts = partitions(spark, 8 * total)
    ranges = max(parts, -(-total // range_tokens))
    frequent = count_frequent(source, text, k, ranges, parts, least_frequent, most_frequent)
    shared = spark.sparkContext.broadcast(frequent)  # at most most_frequent entries
    blobs = postings(source, text, k, ranges, percent, shared, split)
    found = saved(map_rows(blobs.repartition(parts, "r").sortWithinPartitions("r"), FOUND, _links(percent)))
    shared.destroy()
    keys = saved(members.where("n_shingles > 0").groupBy("node").agg(F.min("__key").alias("key")))
    return source, members, found, keys, parts, bool((frequent.count > split).any())


def _whole_leads(found: DataFrame) -> DataFrame:
    """Pairs of the leaders of a whole list with those of its parts."""
    heads = found.where("kind = 3").select("tok", F.struct("a", F.col("na").alias("n"), F.col("la").alias("l")).alias("x"))
    first = heads.groupBy("tok").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    both = heads.join(first, "tok").select(F.explode(F.array("lo", "hi")).alias("y"), "x").where("x.a <> y.a")
    return both.select(F.col("y.a").alias("a"), F.col("x.a").alias("b"), F.col("y.n").alias("na"), F.col("x.n").alias("nb"), F.col("y.l").alias("la"), F.col("x.l").alias("lb"), F.lit(1).alias("c"))


def _entries(found: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of lists of three or more with their components, and the lists that hold several components."""
    entry = found.where("kind = 0").select("tok", F.col("a").alias("node"), F.col("na").alias("n"), F.col("la").alias("l"), F.col("c").alias("place"))
    entry = saved(entry.join(small(roots, 64), "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = entry.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("tok", "size")
    return entry, saved(mixed)


def _candidates(found: DataFrame, entry: DataFrame, mixed: DataFrame, percent: int, parts: int) -> DataFrame:
    """A saved table of pairs (a, b) that may share enough of their prefixes; of lists of three or more only those with different roots, of hot lists none."""
    short = found.where("kind = 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), level_column(percent).alias("need"), "c")
    pairs_of = short.select(F.col("a").alias("node"), "c").unionByName(short.select(F.col("b").alias("node"), "c"))
    mixed = small(mixed, 24)
    own = entry.join(mixed, "tok").select("node", F.lit(1).alias("c"), (F.col("size") > HOT).cast("int").alias("hot"))
    # how many shared shingles a node's pairs can have at most, and how many of them in hot lists
    most = saved(own.unionByName(pairs_of.withColumn("hot", F.lit(0))).groupBy("node").agg(F.sum("c").alias("k"), F.sum("hot").alias("hot")))
    near = small(most, 40)
    dealt = entry.join(mixed.where(F.col("size") <= HOT).select("tok"), "tok").join(near, "node").select("tok", "node", "root", "n", "l", "place", "k", "hot")
    pair = map_rows(dealt.repartition(parts, "tok").sortWithinPartitions("tok"), "a binary, b binary, need int, c int", _across(percent))
    for side in ("a", "b"):
        short = short.join(near.select(F.col("node").alias(side), F.col("k").alias(f"k_{side}"), F.col("hot").alias(f"hot_{side}")), side)
    short = short.where(F.least("k_a", "k_b") >= F.col("need")).select("a", "b", (F.col("need") - F.least("hot_a", "hot_b")).cast("int").alias("need"), "c")
    both = pair.unionByName(short).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need"))
    enough = saved(both.where("c >= need"))
    spent(most)
    return enough


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, least_frequent: int = 16, most_frequent: int = 2_000_000, range_tokens: int = 1_000_000, split: int = SPLIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, n_shingles and component_id, the smallest id reachable by links; and the columns of docs named by carry, which must be no others of these."""
    source, members, found, keys, parts, dealt_out = _prepared(docs, doc_id, text, k, percent, least_frequent, most_frequent, range_tokens, split, list(carry))
    linked: list[DataFrame] = []
    known: list[DataFrame] = []  # the components so far

    def join_in(links: DataFrame) -> DataFrame:
        """Components of all links so far and these."""
        linked.append(links)
        known.append(components(reduce(DataFrame.unionByName, linked)))
        return known[-1].select("node", "root")

    def link(pairs: DataFrame) -> DataFrame:
        return join_in(verify(source, keys, pairs, text, k, percent, parts))

    # first round: each node with its best leader, then with the others that are still in another component
    leads = found.where("kind in (1, 2)").select("a", "b", "na", "nb", "la", "lb", "c")
    if dealt_out:
        leads = leads.unionByName(_whole_leads(found))
    leads = leads.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max(level_column(percent)).alias("need"))
    leads = saved(leads.where("2 * c >= need"))  # lists led by others are not counted in c
    best = saved(leads.groupBy("b").agg(F.max(F.struct("c", "a")).alias("x")).select("x.a", "b"))
    roots = link(best)
    rest = saved(apart(leads.select("a", "b").join(small(best, 48), ["a", "b"], "left_anti"), roots).select("a", "b"))
    spent(leads)
    if not rest.isEmpty():
        roots = link(rest)

    # hot lists: in blocks
    entry, mixed = _entries(found, roots)
    hot = mixed.where(F.col("size") > HOT)
    if not hot.isEmpty():
        roots = join_in(hot_links(source, keys, entry, hot, text, k, percent, parts))
        spent(entry, mixed)
        entry, mixed = _entries(found, roots)

    # second round: what is left between components, first by the best pair of each two components
    enough = _candidates(found, entry, mixed, percent, parts)
    spent(entry, mixed, found)
    tried = best.unionByName(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = saved(apart(enough.join(small(tried, 48), ["a", "b"], "left_anti"), roots))
    spent(enough, best, rest)
    if not second.isEmpty():
        top = F.max(F.struct("c", "a", "b")).alias("x")
        first = saved(second.groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(top).select("x.a", "x.b").distinct())
        roots = link(first)
        third = saved(apart(second, roots).select("a", "b"))
        if not third.isEmpty():
            roots = link(third)
        spent(first, third)
    spent(second, keys, *linked, *known[:-1])

    # a group's smallest id, then back to its rows
    nodes = members.where("n_shingles > 0").join(small(roots, 64), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = small(saved(nodes.groupBy("root").agg(F.min(doc_id).alias("component_id"))), 48)
    grouped = nodes.join(smallest, "root").select(doc_id, "n_shingles", "component_id", *carry)
    return grouped.unionByName(members.where("n_shingles = 0").select(doc_id, "n_shingles", F.col(doc_id).alias("component_id"), *carry))


def near_duplicate_links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, least_frequent: int = 16, most_frequent: int = 2_000_000, range_tokens: int = 1_000_000, split: int = SPLIT) -> DataFrame:
    """All links between different sets, one row each: id_a and id_b, the smallest ids that have the sets, id_a <= id_b (null where no row has an id).

    The second round of near_duplicates with each node a component of its own,
    so the rows within a group of near copies grow with the square of its size.
    """
    source, members, found, keys, parts, _ = _prepared(docs, doc_id, text, k, percent, least_frequent, most_frequent, range_tokens, split, [])
    alone = keys.select("node", F.col("node").alias("root"))
    entry, lists = _entries(found, alone)
    lists = lists.withColumn("size", F.lit(0))  # none is hot: their pairs are what is asked for
    links = verify(source, keys, saved(_candidates(found, entry, lists, percent, parts).select("a", "b")), text, k, percent, parts).distinct()
    ids = members.where("n_shingles > 0").groupBy("node").agg(F.min(doc_id).alias("id"))
    for side in ("a", "b"):
        links = links.join(ids.select(F.col("node").alias(side), F.col("id").alias(f"id_{side}")), side)
    both = F.array_sort(F.array("id_a", "id_b"))  # an unknown id comes last
    return links.select(both[0].alias("id_a"), both[1].alias("id_b"))
