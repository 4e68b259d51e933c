"""Differences of two sequences of words, exact and in linear memory.

The kernel is divide and conquer over rows of the table of common
subsequences, of which only single rows are held until a part's whole table
has at most HELD bits, which are held and traced back. A row is one whole
number with a bit for each word of the other side, so a step covers all its
words at once. What both sides begin and end with is cut off first. The script has
as few deleted and inserted words as there can be.

Jobs with a side of more than `longest` words are compared in tiles of `longest`
words on each side, which Spark deals out: a tile needs of the tile above it a bit
for each word of b, of the tile to its left one for each word of a, and only these borders are kept. Tiles
that don't need each other are worked out at once; then one path is traced back
through at most two tiles for each strip. So a job of any length has a minimal script, a
task holds one tile of it, and the work is the product of its sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import saved

HELD = 1 << 24  # bits of the table that are held at once
PLACES = ("a_start", "a_end", "b_start", "b_end")
#: What tiles are made of (their words, the borders they get, the place where a path enters) and what they give.
PIECE = (("row", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("tokens", pa.list_(pa.string())), ("bits", pa.binary()), ("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64()))


def _bits_of(words: list) -> dict:
    places: dict = {}
    for j, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << j
    return places


def common_lengths(a: Sequence, b: Sequence) -> np.ndarray:
    """Lengths of the longest common subsequences of a and the first 0, 1, ..., len(b) words of b."""
    places = _bits_of(b)
    full = row = (1 << len(b)) - 1
    for word in a:
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))  # a zero is a step up


def _traced(a: list, b: list) -> list[tuple[int, int]]:
    """The pairs of places of a longest common subsequence, from all rows of the table."""
    places = _bits_of(b)
    full = row = (1 << len(b)) - 1
    rows, width = [], len(b) // 8 + 1
    for word in a:
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & full
        rows.append(row.to_bytes(width, "little"))
    pairs, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i - 1, j - 1
        elif rows[i][j >> 3] >> (j & 7) & 1:  # no step up: the word of b isn't needed
            j -= 1
        else:
            i -= 1
    return pairs[::-1]


def _matches(a: list, b: list, i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Appends the pairs of places that a longest common subsequence takes."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out += [(i + x, j + x) for x in range(lo)]
    inner_a, inner_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(inner_a) == 1 or len(inner_b) == 1:
        one, many = (inner_a, inner_b) if len(inner_a) == 1 else (inner_b, inner_a)
        if one[0] in many:
            at = many.index(one[0])
            out.append((i + lo, j + lo + at) if one is inner_a else (i + lo + at, j + lo))
    elif len(inner_a) * len(inner_b) > HELD:
        half = len(inner_a) // 2
        ahead = common_lengths(inner_a[:half], inner_b)
        behind = common_lengths(inner_a[half:][::-1], inner_b[::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        _matches(inner_a[:half], inner_b[:cut], i + lo, j + lo, out)
        _matches(inner_a[half:], inner_b[cut:], i + lo + half, j + lo + cut, out)
    elif inner_a and inner_b:
        out += [(i + lo + x, j + lo + y) for x, y in _traced(inner_a, inner_b)]
    out += [(i + len(a) - x, j + len(b) - x) for x in range(hi, 0, -1)]


def edit_script(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """Runs (op, a_start, a_end, b_start, b_end) with op equal, delete, insert or replace; places from 0, ends exclusive."""
    pairs: list[tuple[int, int]] = []
    _matches(a, b, 0, 0, pairs)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        if (x, y) != (len(a), len(b)):
            if out and out[-1][0] == "equal" and out[-1][2] == x and out[-1][4] == y:
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def _diff(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
    sides = []
    for side in (a, b):
        side = side.sort_by("at")
        sides.append((side.column("token").to_pylist(), side.column("at")[0].as_py() if len(side) else 0))
    (left, i), (right, j) = sides
    rows = [(key[0].as_py(), op, i + x, i + y, j + z, j + w) for op, x, y, z, w in edit_script(left, right)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (key[0].type, pa.string(), *[pa.int64()] * 4)
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("job_id", "op", *PLACES), columns, kinds, strict=True)})


class _Tile:
    """Words of a strip of a and of b, with the row above them (a zero is a step up) and, for each word of a, whether the column to their left steps up."""

    def __init__(self, pieces: pa.Table) -> None:
        self.of = {x["kind"]: x for x in pieces.to_pylist()}
        if self.whole:
            self.a, self.b = self.of["a"]["tokens"], self.of["b"]["tokens"]
            self.full = (1 << len(self.b)) - 1
            self.top = int.from_bytes(self.of["top"]["bits"], "little") if "top" in self.of else self.full
            self.left = np.unpackbits(np.frombuffer(self.of["left"]["bits"], np.uint8), count=len(self.a), bitorder="little").tolist() if "left" in self.of else [0] * len(self.a)
            self.places = _bits_of(self.b)

    @property
    def whole(self) -> bool:
        return "a" in self.of and "b" in self.of

    def rows(self, row: int, begin: int, end: int):
        """(row, whether its last column steps up) after each of a's words from begin to end, given the row before them."""
        for i in range(begin, end):
            hit = row & self.places.get(self.a[i], 0)
            total = row + hit + self.left[i]
            row = total & self.full | row - hit
            yield row, total >> len(self.b)

    def borders(self) -> tuple[bytes, bytes]:
        """What the tile below and the tile to the right get."""
        row, right = self.top, np.zeros(len(self.a), np.uint8)
        for i, (row, up) in enumerate(self.rows(self.top, 0, len(self.a))):
            right[i] = up
        return row.to_bytes(len(self.b) // 8 + 1, "little"), np.packbits(right, bitorder="little").tobytes()

    def traced(self, i: int, j: int) -> tuple[list[tuple[int, int]], int, int]:
        """The pairs on a path from (i, j), the last first, and where it leaves: above the tile i is -1, to its left j is. Rows are kept in about every sqrt(i), and others worked out again."""
        step = isqrt(i) + 1
        kept, pairs = [self.top], []
        for x, (row, _) in enumerate(self.rows(self.top, 0, i + 1), 1):
            if x % step == 0:
                kept.append(row)
        while i >= 0 and j >= 0:
            begin = i // step * step
            rows = [row.to_bytes(len(self.b) // 8 + 1, "little") for row, _ in self.rows(kept[i // step], begin, i + 1)]
            while i >= begin and j >= 0:
                if self.a[i] == self.b[j]:
                    pairs.append((i, j))
                    i, j = i - 1, j - 1
                elif rows[i - begin][j >> 3] >> (j & 7) & 1:
                    j -= 1
                else:
                    i -= 1
        return pairs, i, j


def _pieces(key: tuple, rows: list[dict]) -> pa.Table:
    return pa.table({"job_id": pa.array([key[0].as_py()] * len(rows), key[0].type)} | {name: pa.array([r.get(name) for r in rows], kind) for name, kind in PIECE})


def _across(key: tuple, pieces: pa.Table) -> pa.Table:
    """The borders that a tile gives, as pieces of the tiles that get them."""
    tile, row, col = _Tile(pieces), key[1].as_py(), key[2].as_py()
    if not tile.whole:
        return _pieces(key, [])
    down, right = tile.borders()
    return _pieces(key, [{"row": row + 1, "col": col, "kind": "top", "bits": down}, {"row": row, "col": col + 1, "kind": "left", "bits": right}])


def _back(longest: int):
    def back(key: tuple, pieces: pa.Table) -> pa.Table:
        """The runs of equal words on the path through a tile, and where it enters the next one."""
        tile, row, col = _Tile(pieces), key[1].as_py(), key[2].as_py()
        enter = tile.of["path"]
        pairs, i, j = tile.traced(min(enter["i"], len(tile.a) - 1), min(enter["j"], len(tile.b) - 1))
        runs: list[list[int]] = []
        for x, y in reversed(pairs):
            if runs and runs[-1][0] + runs[-1][2] == x and runs[-1][1] + runs[-1][2] == y:
                runs[-1][2] += 1
            else:
                runs.append([x, y, 1])
        out = [{"kind": "run", "i": row * longest + x, "j": col * longest + y, "n": n} for x, y, n in runs]
        next_ = {"row": row - (i < 0), "col": col - (j < 0), "kind": "path", "i": i if i >= 0 else longest - 1, "j": j if j >= 0 else longest - 1}
        return _pieces(key, out + [next_] * (next_["row"] >= 0 and next_["col"] >= 0))

    return back


def _tiled(a: DataFrame, b: DataFrame, long: DataFrame, longest: int) -> DataFrame:
    """The scripts of long jobs (job_id, a_words, b_words), by tiles."""
    tile = ["job_id", "row", "col"]
    kinds = dict(zip([n for n, _ in PIECE], ["int", "int", "string", "array<string>", "binary", "long", "long", "long"], strict=True))
    schema = T.StructType([a.schema["job_id"], *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in kinds.items()))])
    strips = lambda c: F.ceil(F.col(c) / longest).cast("int")

    def piece(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn("kind", F.lit(kind)).select("job_id", *[(F.col(n) if n in (*rows.columns, "kind") else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    def strip(side: DataFrame, others: str) -> DataFrame:
        own = side.join(long.select("job_id", strips(others).alias("others")), "job_id").groupBy("job_id", F.floor(F.col("at") / longest).cast("int").alias("own"), "others")
        return saved(own.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens")))

    strips_a, strips_b = strip(a, "b_words"), strip(b, "a_words")

    def words_of(d: int) -> DataFrame:
        """The words of the tiles with row + col = d, which don't need each other."""
        own, other = F.col("own").alias("own"), (F.lit(d) - F.col("own"))
        inside = other.between(0, F.col("others") - 1)
        return piece(strips_a.where(inside).select("job_id", own.alias("row"), other.alias("col"), "tokens"), "a").unionByName(piece(strips_b.where(inside).select("job_id", other.alias("row"), own.alias("col"), "tokens"), "b"))

    whole = long.where("a_words > 0 and b_words > 0")
    last, jobs = whole.select(F.max(strips("a_words") + strips("b_words") - 2), F.count("*")).first()
    most = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(pieces: DataFrame, tiles: int):
        """Pieces by tiles; a number of tasks is given, as tiles are much work for their bytes."""
        return pieces.repartition(max(min(tiles, most), 1), *tile).groupBy(*tile)

    borders: list[DataFrame] = []  # those that the tiles with row + col = 1, 2, ... get
    for d in range(last or 0):
        borders.append(saved(dealt(reduce(DataFrame.unionByName, [words_of(d), *borders[-1:]]), jobs * (d + 1)).applyInArrow(_across, schema)))
    paths = [piece(whole.select("job_id", (strips("a_words") - 1).alias("row"), (strips("b_words") - 1).alias("col"), F.lit(longest - 1).alias("i"), F.lit(longest - 1).alias("j")), "path")]
    for d in range(last if last is not None else -1, -1, -1):
        enter = reduce(DataFrame.unionByName, paths[:1] + paths[1:][-2:]).where((F.col("kind") == "path") & (F.col("row") + F.col("col") == d))
        own = reduce(DataFrame.unionByName, [words_of(d), *borders[d - 1 : d]]) if d else words_of(0)
        on_path = own.join(enter.select(*tile), tile, "left_semi").unionByName(enter)
        paths.append(saved(dealt(on_path, jobs).applyInArrow(_back(longest), schema)))
    # what lies between runs differs; a run that begins where another ends goes on
    runs = reduce(DataFrame.unionByName, paths).where("kind = 'run'").select("job_id", "i", "j", "n").unionByName(long.select("job_id", F.col("a_words").alias("i"), F.col("b_words").alias("j"), F.lit(0).cast("long").alias("n")))
    by = Window.partitionBy("job_id").orderBy("i", "j")
    before = lambda c: F.coalesce(F.lag(F.col(c) + F.col("n")).over(by), F.lit(0))
    runs = runs.select("*", before("i").alias("a_start"), before("j").alias("b_start")).withColumn("apart", (F.col("i") > F.col("a_start")) | (F.col("j") > F.col("b_start")))
    runs = runs.withColumn("run", F.sum(F.col("apart").cast("int")).over(by))
    op = F.when((F.col("i") > F.col("a_start")) & (F.col("j") > F.col("b_start")), "replace").when(F.col("i") > F.col("a_start"), "delete").otherwise("insert")
    differ = runs.where("apart").select("job_id", op.alias("op"), "a_start", F.col("i").alias("a_end"), "b_start", F.col("j").alias("b_end"))
    end = lambda c: F.max(F.col(c) + F.col("n"))
    equal = runs.where("n > 0").groupBy("job_id", "run").agg(F.min("i").alias("a_start"), end("i").alias("a_end"), F.min("j").alias("b_start"), end("j").alias("b_end"))
    return differ.unionByName(equal.select("job_id", F.lit("equal").alias("op"), *PLACES))


def sequence_diff(a: DataFrame, b: DataFrame, *, longest: int = 50_000, anchor: int = 8) -> DataFrame:
    """The edit script of each job from a to b (job_id, at, token; places dense from 0): runs as in edit_script.

    Jobs that one side lacks are deleted or inserted whole; null tokens equal each
    other. longest says which jobs are dealt out in tiles and how long a tile's sides are; a script is minimal with
    any. anchor has no effect: runs of words that occur once on each side are no places where
    a script may be cut, as a minimal one need not hold them.
    """
    a, b = (side.select("job_id", F.col("at").cast("long").alias("at"), F.coalesce("token", F.lit("\0")).alias("token"), F.lit(n).alias("side")) for side, n in ((a, "a"), (b, "b")))
    script = T.StructType([a.schema["job_id"], T.StructField("op", T.StringType()), *[T.StructField(c, T.LongType()) for c in PLACES]])
    size = a.unionByName(b).groupBy("job_id").agg(F.count_if(F.col("side") == "a").alias("a_words"), F.count_if(F.col("side") == "b").alias("b_words"))
    long = saved(size.where((F.greatest("a_words", "b_words") > longest) & F.col("job_id").isNotNull()))
    if long.isEmpty():
        return a.groupBy("job_id").cogroup(b.groupBy("job_id")).applyInArrow(_diff, script)
    left, right = (side.join(long, "job_id", "left_anti") for side in (a, b))
    short = left.groupBy("job_id").cogroup(right.groupBy("job_id")).applyInArrow(_diff, script)
    return short.unionByName(_tiled(a, b, long, longest))
