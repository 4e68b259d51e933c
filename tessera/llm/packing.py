"""Best-fit packing of token sequences into bins of several permitted sizes.

Texts longer than the largest size are cut into full pieces and a rest. All
pieces are then packed best-fit decreasing, with the bin sizes chosen jointly:
a piece goes into the open bin with the least room that still holds it; if
none does, the size is opened that promises the least cost per token, its cost
being `overhead` tokens plus its size, and its filling being the piece and as
much of the rest of the room as shorter pieces still to come can fill. At the
end each bin is cut down to the smallest permitted size that holds its
contents.

Lengths are whole numbers up to the largest size, so the packing depends only
on how many pieces each length has. That histogram has at most `max(sizes)`
rows whatever the corpus, and the plan is made from it on the driver: equal
bins are one entry with a multiplicity, and a placement splits at most one
entry. Executors then number the pieces of each length and look up their bins.
The numbering is dealt out by length and a salt, of which a length has as many
as half a task's even share goes into its pieces, or `salt_rows` if that is less;
so a length that a third of all pieces have is still numbered by many tasks.

Nulls and odd input: null, empty and blank texts have no tokens and yield no
piece; rows that repeat an id each yield their own pieces, which differ only
in their bins; a null id is kept; a text of any length gives as many full pieces
as it needs; an empty table gives an empty result. Only the id and the text are
read, so other columns, whatever their names, are left out and can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved, small

SIZES = (512, 1024, 2048, 4096)


class Plan:
    """A packing of counts[n] pieces of each length n.

    An entry stands for `times` bins that are filled alike. Entries that were
    opened together share a root, where each takes up a range from `skip` on;
    a slot is a run of equal pieces placed into such a range.
    """

    def __init__(self, counts: dict[int, int], sizes: Sequence[int], overhead: float) -> None:
        self.sizes, self.overhead = sorted(sizes), overhead
        self.room: list[int] = []  # distinct rooms of open bins, ascending
        self.open: dict[int, list[dict]] = {}  # by room
        self.bins: list[dict] = []
        lengths = sorted(counts, reverse=True)
        self.cum_len = lengths[::-1]
        self.cum = list(accumulate(n * counts[n] for n in self.cum_len))  # tokens in pieces up to each length
        self.slots: list[dict] = []
        for n in lengths:
            self._place(n, counts[n])

    def _short_tokens(self, most: int, below: int) -> int:
        """Tokens in pieces of at most `most` tokens that come after those of `below` tokens."""
        i = bisect_left(self.cum_len, min(most + 1, below))
        return self.cum[i - 1] if i else 0

    def _push(self, entry: dict) -> None:
        room = entry["size"] - entry["used"]
        if room not in self.open or not self.open[room]:
            self.open[room] = []
            insort(self.room, room)
        self.open[room].append(entry)

    def _choose(self, n: int, left: int) -> int:
        """The size to open for a piece of n tokens of which `left` are still to place."""

        def cost(size: int) -> float:
            room = size - n
            own = room // n * n if left > room // n else 0  # more of the same length also fill a bin
            fill = max(own, min(room, own + self._short_tokens(room - own, n)))
            return (size + self.overhead) / (n + fill)

        return min((s for s in self.sizes if s >= n), key=lambda s: (cost(s), s))

    def _place(self, n: int, count: int) -> None:
        rank = 0
        while count:
            i = bisect_left(self.room, n)
            if i < len(self.room):
                room = self.room[i]
                entry = self.open[room].pop()
                if not self.open[room]:
                    del self.room[i]
                take = min(entry["times"], count)
                if take < entry["times"]:  # the others stay open as they are
                    other = {**entry, "times": entry["times"] - take, "skip": entry["skip"] + take}
                    self._push(other)
                    entry["times"] = take
            else:
                size = self._choose(n, count)
                own = 1 + (size - n) // n if count > 1 else 1
                entry = {"size": size, "used": 0, "times": max(1, count // own), "root": len(self.bins), "skip": 0}
                self.bins.append({"times": entry["times"]})
                take = entry["times"]
            self.slots.append({"length": n, "rank": rank, "root": entry["root"], "skip": entry["skip"], "offset": entry["used"], "times": take})
            entry["used"] += n
            rank += take
            count -= take
            if entry["used"] < entry["size"]:
                self._push(entry)
            else:
                self._close(entry)

    def _close(self, entry: dict) -> None:
        self.bins[entry["root"]].setdefault("ends", []).append((entry["skip"], entry["times"], entry["used"]))

    def rows(self) -> list[tuple]:
        """(length, first rank, last rank, first bin, offset, capacity) of each run of pieces, cut where bins end differently."""
        for room in self.room:
            for entry in self.open[room]:
                self._close(entry)
        first, bin_id = [], 0
        for b in self.bins:
            first.append(bin_id)
            bin_id += b["times"]
            b["ends"].sort()
        out = []
        for s in self.slots:
            for skip, times, used in self.bins[s["root"]]["ends"]:
                lo, hi = max(skip, s["skip"]), min(skip + times, s["skip"] + s["times"])
                if lo < hi:
                    size = self.sizes[bisect_left(self.sizes, used)]
                    at = s["rank"] + lo - s["skip"]
                    out.append((s["length"], at, at + hi - lo - 1, first[s["root"]] + lo, s["offset"], size))
        return out


def word_tokens(text: str) -> Column:
    """Number of whitespace-separated words: the default measure of length."""
    return F.regexp_count(text, F.lit(r"\S+"))


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None, sizes: Sequence[int] = SIZES, overhead: float = 16.0, salt_rows: int = 500_000, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row for each piece: id, piece (from 0), first_token, n_tokens, bin_id, bin_offset and bin_size.

    tokens: the number of tokens of a row; words of the text unless given.
    """
    most, session = max(sizes), docs.sparkSession
    counted = saved(docs.select(F.col(doc_id).alias("__id"), F.coalesce(tokens if tokens is not None else word_tokens(text), F.lit(0)).cast("long").alias("__n"), F.xxhash64(text).alias("__h")).where("__n > 0"))
    # full pieces are runs of one length; a long text is one row here and as many pieces as it needs below
    cut = counted.select("__id", "__h", "__n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / most) - 1)).alias("piece"))
    cut = cut.withColumn("n_tokens", F.least(F.lit(most), F.col("__n") - F.col("piece") * most))
    # at most max(sizes) rows: of long texts the full pieces are counted without being listed
    rest, full = F.col("__n") % most, F.floor(F.col("__n") / most)
    counts = {r.n: r.c for r in counted.select(F.explode(F.array(F.struct(rest.alias("n"), F.lit(1).cast("long").alias("c")), F.struct(F.lit(most).cast("long").alias("n"), full.alias("c")))).alias("x")).where("x.n > 0 and x.c > 0").groupBy("x.n").agg(F.sum("x.c").alias("c")).collect()}
    if not counts:
        counts = {1: 0}
    share = max(1, min(salt_rows, sum(counts.values()) // (2 * int(session.conf.get("spark.sql.shuffle.partitions")))))
    salted = F.broadcast(session.createDataFrame([(n, -(-c // share) or 1) for n, c in counts.items()], "n_tokens long, __salts long"))
    cut = cut.join(salted, "n_tokens").withColumn("__salt", F.pmod(F.xxhash64("__id", "__h", "piece"), F.col("__salts"))).drop("__salts")
    groups = saved(cut.groupBy("n_tokens", "__salt").agg(F.count("*").alias("__c")))
    before = Window.partitionBy("n_tokens").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(groups.select("n_tokens", "__salt", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__first")), F.lit(24), broadcast_bytes)
    by_length: dict[int, list[tuple]] = {}
    for r in sorted(Plan(counts, sizes, overhead).rows()):
        by_length.setdefault(r[0], []).append(r[1:])
    plan = F.broadcast(session.createDataFrame([(n, [dict(zip(("a", "b", "bin", "off", "size"), r, strict=True)) for r in rs]) for n, rs in by_length.items()], "n_tokens long, runs array<struct<a:long,b:long,bin:long,off:long,size:long>>"))
    own = Window.partitionBy("n_tokens", "__salt").orderBy("__id", "piece", "__h")
    ranked = cut.withColumn("__r", F.row_number().over(own)).join(offsets, ["n_tokens", "__salt"]).withColumn("__r", F.col("__r") - 1 + F.col("__first"))
    run = F.element_at(F.filter("runs", lambda x: (x["a"] <= F.col("__r")) & (F.col("__r") <= x["b"])), 1)
    placed = ranked.join(plan, "n_tokens").withColumn("__run", run)
    return placed.select(
        F.col("__id").alias(doc_id), F.col("piece").cast("int"), (F.col("piece") * most).cast("long").alias("first_token"), "n_tokens",
        (F.col("__run.bin") + F.col("__r") - F.col("__run.a")).alias("bin_id"), F.col("__run.off").alias("bin_offset"), F.col("__run.size").cast("int").alias("bin_size"),
    )
