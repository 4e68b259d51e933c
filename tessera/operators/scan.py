"""Running aggregates over ordered rows, for keys of any size.

A window partitioned by a key gives all rows of the key to one task. Here rows
are dealt out by ranges of (key, order) instead, so a key that holds most rows
lies in many ranges, and a scan has two levels: windows within each range, and
a carry from range to range. Only the first and the last key of a range can go
on into others, so the carry is worked out from at most two rows for each range
and broadcast. Interval union and the as-of join are built on this.

Rows that are equal in key and order lie in one range and follow each other as
they come; give an order that tells rows apart. Null keys are a key, and nulls
in the order come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import saved

RANGE = "__range"
#: What a scan can keep: how rows are aggregated, and how the carry is put before a value.
KINDS = {
    "max": (F.max, lambda carry, own: F.greatest(carry, own)),
    "min": (F.min, lambda carry, own: F.least(carry, own)),
    "sum": (F.sum, lambda carry, own: F.coalesce(carry + own, carry, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carry, own: F.coalesce(own, carry)),
}


class Ordered:
    """A table whose rows are dealt out by ranges of (key, order)."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], descending: bool) -> None:
        self.rows, self.keys, self.order, self.descending = rows, keys, order, descending

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str], *, descending: bool = False, parts: int | None = None) -> Ordered:
        """df as a saved table of `parts` ranges (as many as shuffle partitions unless given)."""
        own = cls(df, keys, order, descending)
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own.rows = saved(df.repartitionByRange(parts, *keys, *own._by()).withColumn(RANGE, F.spark_partition_id()))
        return own

    def _by(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if self.descending else F.col(c).asc_nulls_first() for c in self.order]

    def scan(self, name: str, kind: str, value: Column, *, before: bool = False) -> Ordered:
        """With the running aggregate of value (max, min, sum or last one that isn't null): up to each row, or of the rows before it."""
        aggregate, put = KINDS[kind]
        window = Window.partitionBy(RANGE, *self.keys).orderBy(*self._by()).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        carry = self._carry(kind, value)
        here = F.col(RANGE) == F.col("__to")
        for k in self.keys:
            here &= F.col(k).eqNullSafe(F.col(f"__key.{k}"))
        rows = self.rows.withColumn(name, aggregate(value).over(window)).join(F.broadcast(carry), here, "left")
        return Ordered(rows.withColumn(name, put(F.col("__carry"), F.col(name))).drop("__to", "__key", "__carry"), self.keys, self.order, self.descending)

    def _carry(self, kind: str, value: Column) -> DataFrame:
        """(__to, __key, __carry): what earlier ranges hold of keys that go on in range __to; at most two rows for each range."""
        aggregate, _ = KINDS[kind]
        key = F.struct(*self.keys).alias("__key")
        edges = self.rows.groupBy(F.col(RANGE).alias("__to")).agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("edge"))
        edges = edges.select("__to", F.explode("edge").alias("__key"))
        if kind == "last":  # by order, as an aggregate meets the rows of a range in any order
            latest = F.min_by if self.descending else F.max_by
            held = latest(value, F.struct(*self.order)).alias("held")
        else:
            held = aggregate(value).alias("held")
        at_edge = (F.col(RANGE) == F.col("__to")) & F.struct(*self.keys).eqNullSafe(F.col("__key"))
        rows = self.rows.where(value.isNotNull()).join(F.broadcast(edges), at_edge).groupBy("__to", "__key").agg(held)
        before = Window.partitionBy("__key").orderBy("__to").rowsBetween(Window.unboundedPreceding, -1)
        every = edges.join(F.broadcast(rows), ["__to", "__key"], "left")
        return every.withColumn("__carry", aggregate(F.col("held")).over(before)).where("__carry is not null").select("__to", "__key", "__carry")


def interval_union(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", *, parts: int | None = None) -> DataFrame:
    """Union of closed intervals for each key, with n of them in each: what merge_intervals gives, for keys of any size. Intervals with a null bound take no part."""
    rows = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, start, end)
    # equal rows are one with a count, so (key, start, end) tells rows apart
    rows = rows.groupBy(*keys, start, end).agg(F.count("*").alias("__n"))
    own = Ordered.of(rows, keys, [start, end], parts=parts).scan("__reach", "max", F.col(end), before=True)
    opened = F.when(F.col(start) <= F.col("__reach"), 0).otherwise(1)
    own.rows = saved(own.rows.withColumn("__open", opened).drop("__reach"))
    island = own.scan("__island", "sum", F.col("__open")).rows
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("__n").alias("n")).drop("__island")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, tie: list[str], *, parts: int | None = None) -> DataFrame:
    """left with the columns of right's latest row of the same key whose right_at is not after `at`; null where there is none.

    Of right's rows with one time the last by `tie` counts. Rows of left without a time find
    nothing, those of right take no part. right's own keys are left out; its other
    columns must not be columns of left. Both sides become one stream in order of
    key and time, right's rows before left's, through which the last row of right is carried.
    """
    own, other = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    if clash := set(own) & set(other):
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    a = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*own).alias("__left"), F.lit(None).cast(right.select(F.struct(*other)).schema[0].dataType).alias("__right"))
    b = right.where(F.col(right_at).isNotNull())
    last = F.max_by(F.struct(*other), F.struct(*tie)) if tie else F.first(F.struct(*other))
    b = b.groupBy(*keys, F.col(right_at).alias("__at")).agg(last.alias("__right")).select(*keys, "__at", F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), "__right")
    # left's rows of one key and time may lie anywhere among themselves: a number deals them out
    both = a.unionByName(b).withColumn("__n", F.when(F.col("__side") == 1, F.monotonically_increasing_id()))
    found = Ordered.of(both, keys, ["__at", "__side", "__n"], parts=parts).scan("__found", "last", F.when(F.col("__at").isNotNull(), F.col("__right"))).rows
    return found.where("__side = 1").select(*keys, *[F.col(f"__left.{c}").alias(c) for c in own], *[F.when(F.col("__at").isNotNull(), F.col(f"__found.{c}")).alias(c) for c in other])


def density(points: DataFrame, keys: list[str], at: str, width: int, *, parts: int | None = None) -> DataFrame:
    """(keys, at, n, within): for each time of a key its points and those from `width` before it up to it, both inclusive.

    Times are whole numbers. A point opens at its time and closes once it is out of
    reach; a running sum over these differences is the count, so rows don't grow with the overlap
    of windows: at most two for each distinct time.
    """
    own = points.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias(at))
    n = own.groupBy(*keys, at).agg(F.count("*").alias("n"))
    turns = n.select(*keys, at, "n", F.col("n").alias("__d")).unionByName(n.select(*keys, (F.col(at) + width + 1).alias(at), F.lit(0).cast("long").alias("n"), (-F.col("n")).alias("__d")))
    turns = turns.groupBy(*keys, at).agg(F.sum("n").alias("n"), F.sum("__d").alias("__d"))
    return Ordered.of(turns, keys, [at], parts=parts).scan("within", "sum", F.col("__d")).rows.where("n > 0").select(*keys, at, "n", "within")
