"""Removal of repeated passages by overlapping three-line windows, in DataFrame functions only.

Lines are what newlines separate. Every run of `lines` consecutive lines of a
text is a window, known by 128 bits: each line is hashed once, and a window's
hash is that of its lines' hashes. Occurrences of a window are ordered by
document and position; the first one stays and the lines that any later one
covers go, so overlapping windows remove the union of their lines. Windows
without any non-space character don't count, and texts of fewer lines are left
alone.

The windows, some 40 bytes each, are written once. A first pass over them counts
windows and finds each first occurrence with partial aggregation, so a window
that a third of all texts hold is combined before the shuffle. Only windows
that occur more than once are kept, and are joined back to the positions. That
join may be skewed, and adaptive execution may split it. Flagged positions are
combined for each document before they meet the text; they are broadcast if
they take at most `broadcast_bytes`, else Spark shuffles.

Nulls and odd input: a null text stays null and has no lines; an empty text is
one empty line; an empty table gives an empty result; rows are told apart by id
and text, so rows that repeat an id with other text are handled as documents of
their own, ordered by text hash, and wholly equal rows are one document and get
equal results; null ids come last. Ids may be of any type that can be ordered.
Input columns named like results are replaced; all others, whatever their
names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import others, saved, small, spent

RESULTS = ["n_lines", "n_removed", "removed_lines"]


def _row_key(doc_id: Column, text: Column) -> Column:
    """Orders rows: null ids last, then by id, then by text."""
    return F.struct(doc_id.isNull().alias("n"), doc_id.alias("d"), F.xxhash64(text).alias("h"))


def _wide_hash(value: Column) -> Column:
    """128 bits of a value, as two integers."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lines: int = 3) -> DataFrame:
    """A saved table: for each document (key) the sorted start positions of windows that occurred before."""
    rows = docs.select(_row_key(F.col(doc_id), F.col(text)).alias("key"), F.split(F.col(text), "\n", -1).alias("l")).where(F.size("l") >= lines)
    # each line once: its hash, and whether it has more than spaces
    hashed = rows.select("key", F.transform("l", lambda x: F.struct(_wide_hash(x).alias("h"), x.rlike(r"\S").alias("full"))).alias("l"))
    starts = F.sequence(F.lit(1), F.size("l") - (lines - 1))
    some = F.transform(starts, lambda i: F.struct(_wide_hash(F.slice("l.h", i, lines)).alias("w"), F.array_contains(F.slice("l.full", i, lines), True).alias("full")))
    windows = hashed.select("key", F.posexplode(some).alias("p", "x")).where("x.full").select("key.*", "p", "x.w.*")
    table = saved(windows)
    windows = table.select(F.struct("n", "d", "h").alias("key"), "p", "a", "b")
    seen = windows.groupBy("a", "b").agg(F.min(F.struct("key", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(seen, ["a", "b"]).where(F.struct("key", "p") != F.col("first"))
    flagged = saved(later.groupBy("key").agg(F.array_sort(F.collect_set("p")).alias("at")))
    spent(table)
    return flagged


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lines: int = 3, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Rows of docs with the text that stays, n_lines, n_removed and removed_lines (positions from 0)."""
    flagged = repeated_windows(docs, doc_id=doc_id, text=text, lines=lines)
    flagged = small(flagged, F.size("at") * 4 + 64, broadcast_bytes)
    keep = others(docs, RESULTS)
    # the row travels as one column, so no name of its own meets another
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _row_key(F.col(doc_id), F.col(text)).alias("own"))
    joined = tagged.join(flagged, F.col("own") == F.col("key"), "left")
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (lines - 1)))))
    bare = joined.select("row", F.coalesce(covered, F.array().cast("array<int>")).alias("gone"), F.split(F.col("row")[text], "\n", -1).alias("lines"))
    # lines is used more than once, so Spark splits each text once and not for each line
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    stays = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    out = F.when(F.size("gone") > 0, stays).otherwise(F.col("row")[text])
    n_lines = F.when(F.col("row")[text].isNull(), 0).otherwise(F.size("lines")).cast("long")
    return bare.select(*[(out if c == text else F.col("row")[c]).alias(c) for c in keep], n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_sort("gone").alias("removed_lines"))
