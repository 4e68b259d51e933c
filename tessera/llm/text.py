"""Byte-level kernels over Arrow string columns.

Spark hands whole texts to Python as UTF-8 Arrow buffers. The functions here
work on those buffers with numpy, a few megabytes at a time, so the cost is a
handful of vector operations per byte and memory stays bounded whatever the
size of a batch. A word is a maximal run of bytes of one class; every class
used here treats all bytes from 0x80 up as word bytes, so a run of bytes is
also a run of whole code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel sees at once (one longer row makes a piece of its own).
PIECE = 1 << 20
#: Bytes that one vector operation covers; its operands stay in cache.
BLOCK = 1 << 17
#: Bytes of a word that polynomial hashes are used for; beyond them different words can be made that have one hash.
WORD = 256

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place."""
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int = 1) -> np.ndarray:
    """A fixed 64-bit code for each byte value, upper-case ASCII letters coded as lower-case."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    codes[65:91] = codes[97:123]
    return codes


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, BLOCK + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


def rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    if not len(column):
        return
    _, at = rows(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """Splits texts into words of a byte class and hashes them; A-Z count as a-z."""

    def __init__(self, is_word: np.ndarray, seed: int = 1) -> None:
        self.is_word, self.powers = is_word, Powers()
        self.codes = np.where(is_word, byte_codes(seed), np.uint64(0)).astype(np.uint64)

    def split(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, word ends, and for each text boundary the number of words before it."""
        inside = self.is_word[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = at[(at > 0) & (at < len(data))]
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, at)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            if ends[i] - starts[i] > BLOCK:
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
            block = data[starts[i] : ends[j - 1]]
            self.powers.need(len(block))
            value, rel = self.codes[block], starts[i:j] - starts[i]
            value *= self.powers.up[: len(block)]
            out[i:j] = np.add.reduceat(value, rel) * self.powers.down[rel]
            i = j
        for i in np.flatnonzero(ends - starts > WORD).tolist():  # equal words are equally long, so they all come here
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes().translate(LOWER), digest_size=8).digest(), "little")
        return mix(out)


    def prefixes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length (below BLOCK) the words that are at least so long and the hashes of their first bytes."""
        out, i = [([], []) for _ in lengths], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
            block = data[starts[i] : min(starts[j - 1] + max(lengths), len(data))]
            self.powers.need(len(block))
            total, rel = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.codes[block] * self.powers.up[: len(block)]))), starts[i:j] - starts[i]
            size = ends[i:j] - starts[i:j]
            for (which, value), n in zip(out, lengths, strict=True):
                some = np.flatnonzero(size >= n)
                at = rel[some]
                which.append(some + i)
                value.append((total[at + n] - total[at]) * self.powers.down[at] + np.uint64(n))
            i = j
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return [(np.concatenate(w), mix(np.concatenate(v))) if w else empty for w, v in out]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, text boundaries ignored."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += words[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    width, out = 1, values
    while 2 * width <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (w - width)], out[w - width :]) if width < w else out


def cut_words(data: np.ndarray, is_word: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about size bytes that don't cut words; a longer word makes a longer range."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and is_word[data[end - 1]] and is_word[data[end]]:
            gap = np.flatnonzero(~is_word[data[end : end + BLOCK]])
            end += int(gap[0]) if len(gap) else BLOCK
        yield at, min(end, len(data))
        at = end


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


#: Digits, letters and everything from 0x80 up.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Letters and everything from 0x80 up.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Everything but space and 0x09 to 0x0D.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
