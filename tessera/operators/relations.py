"""Relations as a whole: several grains at once, the best of each group, and changes between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grains(df: DataFrame, sets: list[list[str]], **measures: Column) -> DataFrame:
    """Aggregates at several grains from one expansion and one exchange.

    Each of sets names the columns of a grain; the others are null there. grain
    is the grouping id: a bit for each column of all sets, the first the
    highest, 1 where the column is summed over, so a null that is data is told
    from one that is not.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id().alias("grain"), *[m.alias(name) for name, m in measures.items()])


def best(df: DataFrame, keys: list[str], measure: str, tie: list[str], k: int, salts: int = 32) -> DataFrame:
    """The k rows of each key with the highest measure, ties by `tie` ascending, with rank from 1; nulls come last.

    Each of `salts` parts of a key keeps k rows before they meet, and Spark
    keeps k of a part's rows in each task before the exchange, so a key of any
    size is neither sorted whole nor read by one task.
    """
    order = [F.col(measure).desc_nulls_last(), *[F.col(c) for c in tie]]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*tie, measure), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "__salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What makes new of old, which have the same columns: distinct rows with change, how many more (or fewer) of them there are.

    Rows are counted with a sign and summed in one exchange; equal rows, nulls
    included, are one. Positive changes are new EXCEPT ALL old, negative ones old EXCEPT ALL new.
    """
    columns = old.columns
    signed = old.withColumn("change", F.lit(-1)).unionByName(new.select(*columns).withColumn("change", F.lit(1)))
    return signed.groupBy(*columns).agg(F.sum("change").alias("change")).where("change <> 0")


def apply_changes(old: DataFrame, feed: DataFrame) -> DataFrame:
    """old with a feed of changes: rows as often as they are left. A feed that takes away more than there is fails."""
    columns = old.columns
    counted = old.withColumn("change", F.lit(1).cast("long")).unionByName(feed.select(*columns, F.col("change").cast("long"))).groupBy(*columns).agg(F.sum("change").alias("n"))
    left = F.when(F.col("n") < 0, F.raise_error(F.lit("a change takes away rows that are not there")).cast("long")).otherwise(F.col("n"))
    return counted.withColumn("n", left).where("n > 0").select(*columns, F.explode(F.expr("sequence(1L, n)"))).drop("col")


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """INTERSECT ALL: distinct rows of both, with n, how often both have them."""
    columns = old.columns
    sides = old.withColumn("__new", F.lit(0)).unionByName(new.select(*columns).withColumn("__new", F.lit(1)))
    return sides.groupBy(*columns).agg(F.least(F.count_if(F.col("__new") == 0), F.count_if(F.col("__new") == 1)).alias("n")).where("n > 0")
