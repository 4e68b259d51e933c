"""Removal of repeated passages with suffix arrays and their common-prefix interval trees.

A byte goes if a string of `span` bytes that covers it also starts in a
document with a smaller id. The work is dealt out by content. Each window of
`span` bytes belongs to the smallest hash among its k-byte grams; windows next
to each other that share that minimiser travel as one substring, and all
occurrences of a string have the same minimiser, so they meet in one task.
Substrings travel in compressed blobs by range of the minimiser. A window that
one input chunk holds several times is shipped once, for the smallest id; the
other documents' copies are known to be repeats there and then. So are copies of
what a task has shipped before, as far as it remembers, which keeps a line that
all documents have from filling one range.

Before that, texts that can't have repeats are thinned out. Whole copies of a
text with a smaller id are settled by their digest. For the others a first
pass sends only 32 bits for each minimiser, with a longer gram, to tasks that
find those of more than one document; what several documents of a chunk have, or
what a task keeps meeting, is sent once. They return to their documents, and
only windows with such a minimiser travel as text.

In a range, equal substrings are one, known by 128 bits of their bytes, and
substrings of different minimisers never meet, so those of a few minimisers are
worked on at a time. Windows that occur in more than one document are found by
hash. Of those, only suffixes at which a repeat can begin are kept: a class of
equal windows whose occurrences all have the same byte to their left only
continues a longer repeat. The kept suffixes are sorted into a suffix array by
their bytes, eight at a time, with the common prefixes of neighbours, and a
stack scan builds the interval tree. An interval is a string with all its
occurrences, held as a range of the sorted suffixes, so nested intervals take no
more memory than their number. Intervals of at least `span` bytes whose left
bytes differ are the maximal repeats. Each suffix is covered by the deepest
maximal repeat that holds it and occurs in a document with a smaller id. The
union over maximal repeats is the union over windows, as each repeated window
lies in a maximal repeat with the same occurrences.

Covered spans return to their documents in blobs, are merged and cut out.

Nulls and odd input: a null text is empty; a null id comes after all others;
rows that repeat an id are never repeats of each other, and each is judged by
its own text; texts shorter than `span` stay whole; an empty table gives an
empty result. Texts longer than a piece are processed in pieces that overlap by
span - 1 bytes. Ids are integers; text that is no number counts as null. Input
columns named like results are replaced; all others, whatever their names, are
kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import hint, map_rows, others, partitions, saved, spent
from tessera.llm.text import Powers, byte_codes, mix, pieces, rows, sliding_min, spans_of

K = 16
FILTER_K = 28  # grams of the first pass
LONGEST = 256  # windows in a substring; longer runs of one minimiser are cut
CHUNK = 2 << 20
REMEMBERED = 60_000  # entries of Seen
GROUP = 1 << 19  # bytes of distinct substrings that are worked on at a time
LAST = np.int64(2**63 - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of the first n positions, as an integer."""
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        part = data[o : o + (len(data) - o) // 8 * 8].view("<u8") if (len(data) - o) >= 8 else np.zeros(0, "<u8")
        m = len(range(o, n, 8))
        out[o::8] = part[:m]
    return out


def minimisers(data: np.ndarray, span: int, k: int = K) -> np.ndarray:
    """The smallest hash of the k-byte grams of each window, for k from 16 up and divisible by 4."""
    n, step = max(len(data) - span + 1, 0), 1 << 16
    out = np.empty(n, np.uint64)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        block = data[lo : hi + span - 1]
        m = len(block) - k + 1
        w = _words(block, len(block) - 7)
        g = w[:m] * _ODD
        for at in [*range(8, k - 8, 8), k - 8]:
            g ^= g >> np.uint64(29)
            g += w[at : m + at]
            g *= _MIX
        g ^= g >> np.uint64(32)
        g *= _ODD
        out[lo:hi] = sliding_min(g, span - k + 1)
    return out


def window_hashes(data: np.ndarray, span: int, powers: Powers, codes: np.ndarray) -> np.ndarray:
    """A hash of each window, blocks at a time."""
    n, step = len(data) - span + 1, 1 << 17
    out = np.empty(max(n, 0), np.uint64)
    powers.need(step + span)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        block = codes[data[lo : hi + span - 1]]
        block *= powers.up[: len(block)]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(block, dtype=np.uint64)))
        out[lo:hi] = (total[span:] - total[:-span]) * powers.down[: hi - lo]
    return mix(out)


SCHEMA = "part int, r int, blob binary"
_CODES = byte_codes(9)
_CODES[65:91] = mix(np.arange(1000, 1026, dtype=np.uint64))  # here case matters


def _chunks(batches: Iterator[pa.RecordBatch], text: str, tags: tuple[str, ...] = ("__id", "__row")) -> Iterator[tuple]:
    """(bytes, boundaries, tags such as ids and row hashes, offsets in their texts, or with keys those) of some texts."""
    for batch in batches:
        for lo, hi in pieces(batch.column(text), CHUNK):
            data, at = rows(batch.column(text).slice(lo, hi - lo))
            ids = np.array([np.asarray(batch.column(c).slice(lo, hi - lo), dtype=np.int64) for c in tags])
            yield data, at, ids, batch.column("keys").slice(lo, hi - lo).to_pylist() if "keys" in batch.schema.names else np.zeros(hi - lo, np.int64)


def _pieces_of(data: np.ndarray, at: np.ndarray, ids: np.ndarray, base: np.ndarray, span: int) -> Iterator[tuple]:
    if len(base) > 1 or len(data) <= 2 * CHUNK:
        yield data, at, ids, base
        return
    for lo in range(0, max(1, len(data) - span + 1), CHUNK):
        part = data[lo : lo + CHUNK + span - 1]
        yield part, np.array([0, len(part)]), ids, base + lo


def _inside(at: np.ndarray, n: int, span: int) -> np.ndarray:
    """Whether each of n windows lies in one text."""
    edge = np.zeros(n + 1, np.int32)
    a, b = np.minimum(at[:-1], n), np.minimum(np.maximum(at[1:] - span + 1, at[:-1]), n)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge[:n]) > 0


class Seen:
    """What a task has sent of late: the last REMEMBERED entries and up to as many more, the often seen ones for good.

    It only saves sending, so what it forgets is sent again.
    """

    def __init__(self) -> None:
        self.young, self.old = {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _anchors(span: int, ranges: int, buckets: int, text: str):
    """First pass: 32 bits of each minimiser by range, from one document of a chunk (part 0).

    What several documents of the chunk have, or a document of the chunk and one
    whose anchor this task has sent, is known to be shared and goes to those
    documents at once (part 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press, seen = zstandard.ZstdCompressor(level=1), Seen()
        for chunk in _chunks(batches, text, ("__at",)):
            for data, at, (own_at,), _ in _pieces_of(*chunk, span):
                low = minimisers(data, span, FILTER_K)
                if not len(low):
                    continue
                new = _inside(at, len(low), span)
                change = np.concatenate(([True], low[1:] != low[:-1]))
                change[at[at < len(low)]] = True
                where = np.flatnonzero(new & (change | np.concatenate(([True], ~new[:-1]))))
                if not len(where):
                    continue
                doc = np.searchsorted(at, where, "right") - 1
                value = low[where] * _ODD
                del low, new, change
                order = np.lexsort((doc, value))
                doc, value = doc[order], value[order]
                fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
                doc, value = doc[fresh], value[fresh]
                first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                many = np.minimum.reduceat(own_at[doc], first) != np.maximum.reduceat(own_at[doc], first)
                known = np.repeat(many, np.diff(np.append(first, len(value))))
                if known.any():
                    yield from _keys_to_documents(own_at[doc[known]], (value[known] & np.uint64(0xFFFFFFFF)).astype(np.uint32), buckets, press)
                # the others, and of each known key one
                lone = ~known
                lone[first] = True
                doc, value = doc[lone], value[lone]
                before = [seen.get(v) for v in value.tolist()]
                again = np.array([b is not None and b != a for b, a in zip(before, own_at[doc].tolist(), strict=True)], bool)
                for v, a, b in zip(value.tolist(), own_at[doc].tolist(), before, strict=True):
                    if b is None:
                        seen.put(v, a)
                if again.any():
                    both = np.concatenate((own_at[doc[again]], np.array([b for b, x in zip(before, again.tolist(), strict=True) if x], np.int64)))
                    yield from _keys_to_documents(both, np.tile((value[again] & np.uint64(0xFFFFFFFF)).astype(np.uint32), 2), buckets, press)
                doc, value = doc[~again], value[~again]
                r = ((value >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((doc, r))
                r, doc, key = r[order], doc[order], (value[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                edge = np.searchsorted(r, np.arange(ranges + 1))
                for q in np.unique(r).tolist():
                    a, b = edge[q], edge[q + 1]
                    here, own = np.unique(doc[a:b], return_inverse=True)
                    body = np.array([len(here), b - a], np.int32).tobytes() + own_at[here].tobytes() + np.diff(own, prepend=0).astype(np.int32).tobytes()
                    yield {"part": [0], "r": [q], "blob": [_pack(press, body, key[a:b])]}

    return run


def _keys_to_documents(doc: np.ndarray, key: np.ndarray, buckets: int, press) -> Iterator[dict]:
    """Keys as blobs by bucket of documents."""
    bucket = _bucket_of(doc, buckets)
    order = np.lexsort((doc, bucket))
    doc, key, bucket = doc[order], key[order], bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True):
        here, own = np.unique(doc[a:b], return_inverse=True)
        body = np.array([len(here), b - a], np.int32).tobytes() + here.tobytes() + np.diff(own, prepend=0).astype(np.int32).tobytes()
        yield {"part": [1], "r": [int(bucket[a])], "blob": [_pack(press, body, key[a:b])]}


def _pack(press, body: bytes, keys: np.ndarray) -> bytes:
    """keys are random bits, so only the rest is compressed."""
    small = press.compress(body)
    return np.int32(len(small)).tobytes() + small + keys.tobytes()


def _unpack(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their keys."""
    open_, docs, keys = zstandard.ZstdDecompressor(), [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int32, 1)[0])
        body = open_.decompress(blob[4 : 4 + n])
        d, e = (int(x) for x in np.frombuffer(body, np.int32, 2))
        docs.append(np.frombuffer(body, np.int64, d, 8)[np.cumsum(np.frombuffer(body, np.int32, e, 8 + 8 * d))])
        keys.append(np.frombuffer(blob, np.uint32, e, 4 + n))
    return np.concatenate(docs), np.concatenate(keys)


def _shared(buckets: int):
    """Minimisers of more than one document, sent back to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press = zstandard.ZstdCompressor(level=1)
        for part, r, blobs in _groups(batches):
            if part == 1:
                for blob in blobs:  # already known
                    yield {"part": [1], "r": [r], "blob": [blob]}
                continue
            doc, key = _unpack(blobs)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            own = doc[order]
            many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            keep = np.repeat(many, np.diff(np.append(first, len(key))))
            if keep.any():
                yield from _keys_to_documents(own[keep], key[keep], buckets, press)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The shared minimisers of each document."""
    for _, _, blobs in _groups(batches):
        doc, key = _unpack(blobs)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
        doc, key = doc[new], key[new]
        cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        stop = np.append(cut[1:], len(key))
        for lo in range(0, len(cut), 2000):
            a, b = cut[lo : lo + 2000], stop[lo : lo + 2000]
            yield {"__at": doc[a], "keys": [key[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]}


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (((ids.astype(np.uint64) * _MIX) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _wanted(data: np.ndarray, at: np.ndarray, keys: list[bytes], span: int) -> np.ndarray:
    """Whether each window's first-pass minimiser is among its document's keys."""
    low = minimisers(data, span, FILTER_K)
    change = np.concatenate(([True], low[1:] != low[:-1]))
    change[at[at < len(low)]] = True
    runs = np.flatnonzero(change)
    doc = np.searchsorted(at, runs, "right") - 1
    # document number and key as one sorted integer
    sizes = [len(k) // 4 for k in keys]
    known = (np.repeat(np.arange(len(keys)), sizes).astype(np.uint64) << np.uint64(32)) | np.frombuffer(b"".join(keys), np.uint32)
    own = (doc.astype(np.uint64) << np.uint64(32)) | ((low[runs] * _ODD) & np.uint64(0xFFFFFFFF))
    hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
    return np.repeat(hit, np.diff(np.append(runs, len(low))))


def _spread(span: int, ranges: int, buckets: int, text: str):
    """Substrings to their ranges (part 0); repeats known in a chunk to their documents (part 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press, seen = zstandard.ZstdCompressor(level=1), Seen()
        for *chunk, keys in _chunks(batches, text):
            for data, at, ids, base in _pieces_of(*chunk, np.zeros(len(keys), np.int64), span):
                low = minimisers(data, span)
                if not len(low):
                    continue
                n = len(low)
                start = np.zeros(n, bool)
                start[0] = True
                start[1:] = low[1:] != low[:-1]
                cut = at[at < n]
                start[cut] = True
                ok = _inside(at, n, span) & _wanted(data, at, keys, span)
                start[1:] |= ok[1:] != ok[:-1]
                runs = np.flatnonzero(start)
                for a, b in zip(runs.tolist(), [*runs[1:].tolist(), n], strict=True) if n > LONGEST else ():
                    if b - a > LONGEST:
                        start[a:b:LONGEST] = True
                runs = np.flatnonzero(start)
                ends = np.append(runs[1:], n)
                good = ok[runs]
                runs, ends = runs[good], ends[good]
                if not len(runs):
                    continue
                doc = np.searchsorted(at, runs, "right") - 1
                size = ends - runs + span - 1
                # runs of equal bytes, by 128 bits of them: kept for the smallest id
                h = _digests(data, runs, size)
                order = np.lexsort((runs, ids[0][doc], h[:, 1], h[:, 0]))
                same = np.zeros(len(order), bool)
                same[1:] = (h[order][1:] == h[order][:-1]).all(axis=1)
                group = np.cumsum(~same) - 1
                first = order[np.flatnonzero(~same)][group]
                known = same & (ids[0][doc[order]] != ids[0][doc[first]])
                # the same of runs that this task has sent for a smaller id
                heads = np.flatnonzero(~same)
                raw = h.tobytes()
                for at_, i in zip(heads.tolist(), order[heads].tolist(), strict=True):
                    key, own = raw[16 * i : 16 * i + 16], int(ids[0][doc[i]])
                    least = seen.get(key)
                    if least is not None and least < own:
                        known[at_] = True
                    elif least is None or own < least:
                        seen.put(key, own)
                gone = order[known]
                if len(gone):
                    yield from _to_documents(ids[:, doc[gone]], base[doc[gone]] + runs[gone] - at[doc[gone]], size[gone], buckets, press)
                left = np.sort(order[~known])
                runs, size, doc = runs[left], size[left], doc[left]
                r = (((low[runs] * _ODD) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(r, kind="stable")
                edge = np.searchsorted(r[order], np.arange(ranges + 1))
                for q in np.unique(r).tolist():
                    own = order[edge[q] : edge[q + 1]]
                    at_byte = np.repeat(runs[own] - np.concatenate(([0], np.cumsum(size[own])[:-1])), size[own]) + np.arange(size[own].sum())
                    here, local = np.unique(doc[own], return_inverse=True)
                    head = np.array([len(here), len(own)], np.int32).tobytes()
                    body = head + ids[:, here].tobytes() + base[here].tobytes() + np.diff(local, prepend=0).astype(np.int32).tobytes() + (runs[own] - at[doc[own]]).astype(np.int32).tobytes() + size[own].astype(np.int32).tobytes() + data[at_byte].tobytes()
                    yield {"part": [0], "r": [q], "blob": [press.compress(body)]}

    return run


def _digests(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of each run of bytes, as two integers."""
    raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def _to_documents(ids: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int, press) -> Iterator[dict]:
    """Spans as blobs by bucket of documents (id and row hash)."""
    bucket = _bucket_of(ids[0], buckets)
    order = np.lexsort((start, ids[1], ids[0], bucket))
    ids, start, end, bucket = ids[:, order], start[order], (start + size)[order], bucket[order]
    new = np.ones(len(start), bool)
    new[1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)  # spans that touch in a document are one
    end = np.maximum.reduceat(end, first)
    ids, start, bucket = ids[:, first], start[first], bucket[first]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(start)], strict=True):
        yield {"part": [1], "r": [int(bucket[a])], "blob": [press.compress(np.concatenate((ids[0, a:b], ids[1, a:b], start[a:b], end[a:b])).tobytes())]}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """(part, range, blobs one by one); rows come sorted by both, and each group is read before the next."""
    stream = ((part, r, blob.as_py()) for batch in batches for part, r, blob in zip(batch.column("part").to_pylist(), batch.column("r").to_pylist(), batch.column("blob"), strict=True))
    for (part, r), own in groupby(stream, key=lambda x: x[:2]):
        yield part, r, (x[2] for x in own)


class Pool:
    """The substrings of a range: bytes of each kind of equal ones, and each occurrence's kind, id, row hash and place."""

    def __init__(self, blobs: Iterator[bytes]) -> None:
        open_, number, data = zstandard.ZstdDecompressor(), {}, bytearray()
        kind, ids, pos, width = [], [], [], []
        for blob in blobs:
            blob = open_.decompress(blob)
            d, e = (int(x) for x in np.frombuffer(blob, np.int32, 2))
            own, base = np.frombuffer(blob, np.int64, 2 * d, 8).reshape(2, -1), np.frombuffer(blob, np.int64, d, 8 + 16 * d)
            p = 8 + 24 * d
            local = np.cumsum(np.frombuffer(blob, np.int32, e, p))
            ids.append(own[:, local])
            pos.append(base[local] + np.frombuffer(blob, np.int32, e, p + 4 * e))
            size = np.frombuffer(blob, np.int32, e, p + 8 * e).astype(np.int64)
            body = memoryview(blob)[p + 12 * e :]
            which, at = np.empty(e, np.int32), 0
            for i, n in enumerate(size.tolist()):
                part = body[at : at + n]
                key = xxhash.xxh3_128_digest(part)
                at += n
                if (known := number.get(key)) is None:
                    known = number[key] = len(number)
                    data += part
                    width.append(n)
                which[i] = known
            kind.append(which)
        self.data, self.size = np.frombuffer(bytes(data), np.uint8), np.array(width, np.int64)
        self.kind, self.ids, self.pos = np.concatenate(kind), np.concatenate(ids, axis=1), np.concatenate(pos)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.least = np.full(len(self.size), LAST)
        np.minimum.at(self.least, self.kind, self.ids[0])

    def groups(self, span: int) -> Iterator[np.ndarray]:
        """Kinds of a few minimisers at a time, those left out that can't hold a repeat of another document."""
        n = len(self.size)
        low = np.empty(n, np.uint64)
        for lo in range(0, n, 1 << 14):  # all windows of a substring have the minimiser of its first one
            first = (self.start[lo : min(n, lo + (1 << 14))][:, None] + np.arange(span)).ravel()
            low[lo : lo + (1 << 14)] = minimisers(self.data[first], span)[::span]
        order = np.argsort(low, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], low[order][1:] != low[order][:-1])))
        least = self.least[order]
        some = np.minimum.reduceat(least, edge) != np.maximum.reduceat(least, edge)
        stop, weight = np.append(edge[1:], n), np.add.reduceat(self.size[order], edge)
        own, total = [], 0
        for a, b, w in zip(edge[some].tolist(), stop[some].tolist(), weight[some].tolist(), strict=True):
            if own and total + w > GROUP:
                yield np.concatenate(own)
                own, total = [], 0
            own.append(order[a:b])
            total += w
        if own:
            yield np.concatenate(own)


def suffix_array(data: np.ndarray, suffixes: np.ndarray, ends: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes, each cut at its end, and what each has in common with the one before it.

    They are sorted by eight bytes, and those that are still equal by the next
    eight. With group, suffixes of different groups are not compared and have
    nothing in common.
    """
    words = _words(np.concatenate((data, np.zeros(8, np.uint8))), len(data) + 1).byteswap()
    order = np.arange(len(suffixes)) if group is None else np.argsort(group, kind="stable")
    common, live, done = np.zeros(len(suffixes), np.int64), np.arange(len(suffixes)), 0
    tie = np.zeros(len(order), np.int64) if group is None else np.cumsum(np.concatenate(([True], group[order][1:] != group[order][:-1])))
    steps = np.array([1 << (8 * i) for i in range(1, 8)], np.uint64)
    masks = np.array([(1 << 64) - (1 << (64 - 8 * i)) for i in range(9)], np.uint64)
    while True:
        same = tie[1:] == tie[:-1]
        stay = np.concatenate((same, [False])) | np.concatenate(([False], same))  # not alone in their tie
        live, tie = live[stay], tie[stay]
        if not len(live):
            return order, common
        own = order[live]
        at = suffixes[own] + done
        rest = np.minimum(ends[own] - at, 8)
        key = words[at] & masks[rest]
        by = np.lexsort((rest, key, tie))
        order[live], key, rest = own[by], key[by], rest[by]
        same = tie[1:] == tie[:-1]
        equal = same & (key[1:] == key[:-1]) & (rest[1:] == rest[:-1])
        alike = 7 - np.searchsorted(steps, key[1:] ^ key[:-1], "right")
        settled = same & (~equal | (rest[1:] < 8))
        alike = np.minimum(np.where(key[1:] == key[:-1], 8, alike), np.minimum(rest[1:], rest[:-1]))
        common[live[1:][settled]] = done + alike[settled]
        tie = np.cumsum(np.concatenate(([True], ~equal | (rest[1:] < 8))))
        done += 8


class Intervals(NamedTuple):
    """Nodes of an interval tree, by number, and the deepest node (home) of each sorted suffix, -1 for none."""

    depth: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    parent: np.ndarray
    diverse: np.ndarray
    least: np.ndarray
    home: np.ndarray


def interval_tree(common: np.ndarray, left: np.ndarray, ids: np.ndarray, span: int) -> Intervals:
    """The intervals of at least span bytes, by a stack scan over what sorted neighbours have in common.

    left: the byte to the left of each sorted suffix, or a negative number that
    differs from every other if there is none; ids: its document. diverse: the
    bytes to the left of an interval's occurrences are not all equal; least: its
    smallest id.
    """
    depth, lo, hi, parent, diverse, least, byte = [], [], [], [], [], [], []
    home, stack, before = [-1] * len(left), [], 0
    left, ids = left.tolist(), ids.tolist()

    def add(v: int, some: int, smallest: int, differ: bool) -> None:
        if smallest < least[v]:
            least[v] = smallest
        if differ or byte[v] != some:
            diverse[v] = True

    for i, now in enumerate([*common[1:].tolist(), 0], 1):
        now = now if now >= span else 0
        if not now and not before:
            continue
        top, first, child = stack[-1] if stack else -1, i - 1, -1
        if now <= before:
            home[i - 1] = top
            add(top, left[i - 1], ids[i - 1], False)
        while stack and depth[stack[-1]] > now:
            child = stack.pop()
            hi[child], first = i, lo[child]
            if stack and depth[stack[-1]] >= now:
                parent[child] = stack[-1]
                add(stack[-1], byte[child], least[child], diverse[child])
                child = -1
        if now and not (stack and depth[stack[-1]] == now):
            v = len(depth)
            for column, value in ((depth, now), (lo, first), (hi, -1), (parent, -1), (diverse, False), (least, LAST), (byte, left[first])):
                column.append(value)
            stack.append(v)
            if child >= 0:
                parent[child] = v
                add(v, byte[child], least[child], diverse[child])
        if now > before:
            home[i - 1] = stack[-1]
            add(stack[-1], left[i - 1], ids[i - 1], False)
        before = now
    return Intervals(*(np.array(x, np.int64) for x in (depth, lo, hi, parent)), np.array(diverse, bool), np.array(least, np.int64), np.array(home, np.int64))


def maximal_repeats(data: bytes, suffixes: np.ndarray, ends: np.ndarray, before: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, suffixes) of each maximal repeat of at least span bytes among the given suffixes of data, with all its occurrences.

    ends: where each suffix's substring ends; before: as left of interval_tree.
    """
    order, common = suffix_array(np.frombuffer(data, np.uint8), suffixes, ends)
    tree = interval_tree(common, before[order], np.zeros(len(order), np.int64), span)
    for v in np.flatnonzero(tree.diverse).tolist():
        yield int(tree.depth[v]), order[tree.lo[v] : tree.hi[v]]


def deepest_of_others(tree: Intervals, ids: np.ndarray) -> np.ndarray:
    """For each sorted suffix the deepest maximal repeat that holds it and has a smaller id than its own, -1 for none."""
    n = len(tree.depth)
    nearest, lower = [-1] * (n + 1), [-1] * (n + 1)  # of each node: itself or an ancestor that is diverse; the same with a smaller id than its own
    parent, diverse, least = tree.parent.tolist(), tree.diverse.tolist(), tree.least.tolist()
    for v in np.argsort(tree.depth, kind="stable").tolist():  # parents are less deep
        up = nearest[parent[v]]
        nearest[v] = v if diverse[v] else up
        lower[v] = up if up < 0 or least[up] < least[v] else lower[up]
    home = tree.home
    return np.where(home < 0, -1, np.where(ids > np.append(tree.least, LAST)[home], np.array(nearest)[home], np.array(lower)[home]))


def repeats_among(data: np.ndarray, size: np.ndarray, least: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(substring, start, length) of what maximal repeats cover outside their smallest documents.

    data: distinct substrings end to end; least: the smallest id of each.
    """
    starts = np.concatenate(([0], np.cumsum(size)))
    h = window_hashes(data, span, Powers(), _CODES)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[:-1]] += 1
    edge[starts[1:] - span + 1] -= 1
    inside = np.flatnonzero(np.cumsum(edge[: len(h)], dtype=np.int8) > 0)  # windows in one substring
    h, out = h[inside], []
    parts = -(-len(data) // (2 * GROUP))  # equal windows come into one part
    which = None if parts == 1 else ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    for p in range(parts):
        where, value = (inside, h) if which is None else (inside[which == p], h[which == p])
        if not len(where):
            continue
        by = np.argsort(value, kind="stable")
        where, value = where[by], value[by]
        own = np.searchsorted(starts, where, "right") - 1
        group = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        width = np.diff(np.append(group, len(where)))
        at_start = where == starts[own]
        # without a known byte to the left an occurrence differs from all others
        byte = np.where(at_start, -1 - np.arange(len(where)), data[np.maximum(where - 1, 0)].astype(np.int64))
        several = np.minimum.reduceat(least[own], group) != np.maximum.reduceat(least[own], group)
        # a substring's first window may begin in the middle of a repeat whose earlier windows went elsewhere
        diverse = (np.minimum.reduceat(byte, group) != np.maximum.reduceat(byte, group)) | np.logical_or.reduceat(at_start, group)
        keep = np.repeat(several & diverse, width)
        where, own, byte, value = where[keep], own[keep], byte[keep], value[keep]
        if not len(where):
            continue
        order, common = suffix_array(data, where, starts[own + 1], value)
        where, own, byte = where[order], own[order], byte[order]
        tree = interval_tree(common, byte, least[own], span)
        repeat = deepest_of_others(tree, least[own])
        later = repeat >= 0
        out.append((own[later], (where - starts[own])[later], tree.depth[repeat[later]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeats_of(pool: Pool, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id and row hash, start, length) of what maximal repeats of a range cover outside their smallest documents."""
    # a substring that documents share is a repeat as a whole
    whole = np.flatnonzero(pool.ids[0] > pool.least[pool.kind])
    if len(whole):
        yield pool.ids[:, whole], pool.pos[whole], pool.size[pool.kind[whole]]
    # of the others' kinds, what the smallest id has
    rest = np.flatnonzero(pool.ids[0] == pool.least[pool.kind])
    rest = rest[np.argsort(pool.kind[rest], kind="stable")]
    edge = np.searchsorted(pool.kind[rest], np.arange(len(pool.size) + 1))
    for kinds in pool.groups(span):
        size = pool.size[kinds]
        data = pool.data[np.repeat(pool.start[kinds] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
        own, start, length = repeats_among(data, size, pool.least[kinds], span)
        if len(own):
            of, start, end = _union(kinds[own], start, start + length)
            times = edge[of + 1] - edge[of]
            each = rest[np.repeat(edge[of], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            yield pool.ids[:, each], pool.pos[each] + np.repeat(start, times), np.repeat(end - start, times)


def _union(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each group, merged where they meet."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    wide = int(end.max()) + 1  # all groups on one line, each shifted by more than the longest reach
    number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    reach = np.maximum.accumulate(end + number * wide)
    first = np.flatnonzero(np.concatenate(([True], (start + number * wide)[1:] > reach[:-1])))
    last = np.append(first[1:], len(group)) - 1
    return group[first], start[first], reach[last] - number[first] * wide


def _find(span: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press = zstandard.ZstdCompressor(level=1)
        for part, r, blobs in _groups(batches):
            if part == 1:
                for blob in blobs:  # already known
                    yield {"part": [1], "r": [r], "blob": [blob]}
                continue
            for found in repeats_of(Pool(blobs), span):
                yield from _to_documents(*found, buckets, press)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Spans of each document, merged."""
    open_ = zstandard.ZstdDecompressor()
    for _, _, blobs in _groups(batches):
        ids, row, start, end = np.concatenate([np.frombuffer(open_.decompress(b), np.int64).reshape(4, -1) for b in blobs], axis=1)
        order = np.lexsort((start, row, ids))
        ids, row, start, end = ids[order], row[order], start[order], end[order]
        other = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
        # all documents on one line: each is shifted by more than the longest reach
        number, wide = np.concatenate(([0], np.cumsum(other))), int(end.max()) + 1
        reach = np.maximum.accumulate(end + number * wide)
        first = np.flatnonzero(np.concatenate(([True], (start + number * wide)[1:] > reach[:-1])))
        last = np.append(first[1:], len(ids)) - 1
        ids, row, start, end, number = ids[first], row[first], start[first], reach[last] - number[first] * wide, number[first]
        cut = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        stop = np.append(cut[1:], len(ids))
        for lo in range(0, len(cut), 2000):
            a, b = cut[lo : lo + 2000], stop[lo : lo + 2000]
            yield {"__id": ids[a], "__row": row[a], "spans": [np.concatenate((start[x:y], end[x:y])).tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]}


def _cut(column: pa.Array, spans: pa.Array, copies: pa.Array) -> list[pa.Array]:
    data, at = rows(column)
    kept, removed, runs = [], [], []
    for i, (blob, copy) in enumerate(zip(spans.to_pylist(), copies.to_pylist(), strict=True)):
        own = data[at[i] : at[i + 1]]
        if copy:
            kept.append(b"")
            removed.append(len(own))
            runs.append([{"start": 0, "end": len(own)}])
            continue
        if blob is None:
            kept.append(own.tobytes())
            removed.append(0)
            runs.append([])
            continue
        start, end = np.frombuffer(blob, np.int64).reshape(2, -1)
        flags = np.zeros(len(own) + 1, np.int32)
        np.add.at(flags, start, 1)
        np.add.at(flags, end, -1)
        gone = np.cumsum(flags[:-1]) > 0
        a, b = spans_of(gone)
        kept.append(own[~gone].tobytes())
        removed.append(int(gone.sum()))
        runs.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, span: int = 50, range_bytes: int = 4 << 20, broadcast_bytes: int = 8 << 20, span_bytes: int = 32 << 20, broadcast_rows: int = 500_000) -> DataFrame:
    """Each row of docs with kept (bytes that stay), n_removed and removed (byte spans)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    tags = [F.coalesce(F.col(doc_id).try_cast("long"), F.lit(int(LAST))).alias("__id"), F.xxhash64(body).alias("__row"), body.alias("__text")]
    tagged = docs.select(*tags).withColumn("__digest", F.md5(F.col("__text").cast("binary"))).where(F.octet_length("__text") >= span)
    total = tagged.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    # whole copies: of each text that several ids have, the smallest id
    same = saved(tagged.groupBy("__digest").agg(F.min("__id").alias("__least"), F.max("__id").alias("__most")).where("__least <> __most").select("__digest", "__least"))
    same = hint(same, broadcast_rows)
    source = tagged.join(same, "__digest", "left").where(F.col("__least").isNull() | (F.col("__least") == F.col("__id"))).select("__id", "__row", F.xxhash64("__id", "__row").alias("__at"), "__text")
    parts = partitions(spark, total)
    ranges = max(parts, -(-total // range_bytes))
    buckets = max(parts, -(-total // (4 * range_bytes)))  # of 16 MB of text unless ranges are set otherwise
    first = map_rows(source, SCHEMA, _anchors(span, buckets, buckets, "__text")).repartition(parts, "part", "r").sortWithinPartitions("part", "r")
    back = map_rows(first, SCHEMA, _shared(buckets)).repartition(parts, "r").sortWithinPartitions("part", "r")
    keys = saved(map_rows(back, "__at long, keys binary", _gather))
    weight = keys.agg(F.sum(F.octet_length("keys") + 40)).first()[0] or 0
    keyed = source.join(F.broadcast(keys) if weight <= broadcast_bytes else keys, "__at")  # documents that share an address share keys, which adds to the work and not to the result
    far = map_rows(keyed, SCHEMA, _spread(span, ranges, buckets, "__text")).repartition(parts, "part", "r").sortWithinPartitions("part", "r")
    found = map_rows(far, SCHEMA, _find(span, buckets)).repartition(parts, "r").sortWithinPartitions("r")
    spans = saved(map_rows(found.withColumn("part", F.lit(1)), "__id long, __row long, spans binary", _merge))
    spent(keys)
    weight = spans.agg(F.sum(F.octet_length("spans") + 40)).first()[0] or 0
    names = ["kept", "n_removed", "removed"]
    keep = others(docs.select(*keep) if keep else docs, names)
    # the kept columns travel as one, so no name of theirs meets another
    own = docs.select(F.struct(F.lit(0).alias("none") if not keep else F.col(f"`{keep[0]}`"), *[F.col(f"`{c}`") for c in keep[1:]]).alias("__own"), *tags).withColumn("__digest", F.md5(F.col("__text").cast("binary")))
    copy = F.coalesce((F.octet_length("__text") >= span) & (F.col("__least") < F.col("__id")), F.lit(False)).alias("__copy")
    joined = own.join(same, "__digest", "left").join(F.broadcast(spans) if weight <= span_bytes else spans, ["__id", "__row"], "left")
    schema = T.StructType([own.schema["__own"], T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi in pieces(batch.column("__text")):
                part = batch.slice(lo, hi - lo)
                new = _cut(part.column("__text"), part.column("spans"), part.column("__copy"))
                yield {"__own": part.column("__own")} | dict(zip(names, new, strict=True))

    return map_rows(joined.select("__own", "__text", "spans", copy), schema, run).select(*[F.col("__own")[c].alias(c) for c in keep], *names)
