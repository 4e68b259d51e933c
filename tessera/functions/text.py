"""Column functions over words, times, sizes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation, stripped from both ends of a token.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Runs of non-space characters, in order; empty for blank or null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def strip_punctuation(word: Column) -> Column:
    """Without ASCII punctuation at both ends; what is inside stays."""
    return F.btrim(word, F.lit(PUNCTUATION))


def _clock(s: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def to_grid(seconds: Column) -> Column:
    """Seconds rounded to four decimals, as transcripts and logs hold them; whole numbers stay as they are."""
    return F.round(seconds, 4)


def duration(seconds: Column) -> Column:
    """HH:MM:SS of the whole seconds; hours may exceed two digits."""
    return _clock(F.floor(seconds).cast("long"))


def clock_tenths(seconds: Column) -> Column:
    """HH:MM:SS.d, tenths rounded half to even."""
    tenths = F.bround(seconds * 10).cast("long")
    return F.concat(_clock(F.floor(tenths / 10).cast("long")), F.lit("."), (tenths % 10).cast("string"))


def parse_time(text: Column) -> Column:
    """Seconds of `S`, `MM:SS` or `HH:MM:SS`, each with a fraction; null for anything else."""
    s = strip(text)
    part = F.split(s, ":")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    plain = F.when(s.rlike(r"^[0-9.:]+$") & ~s.rlike(r"(^|:)\.?(:|$)"), F.size(part))
    return F.when(plain == 1, number(1)).when(plain == 2, number(1) * 60 + number(2)).when(plain == 3, number(1) * 3600 + number(2) * 60 + number(3))


def size(n: Column) -> Column:
    """Bytes in steps of 1024: no decimals for B, else one, halves to even."""
    n, out = n.cast("double"), None
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.format_string("%.0f B" if power == 0 else f"%.1f {unit}", F.bround(n / 1024**power, 1))
        out = F.when(n < 1024 ** (power + 1), text) if out is None else out.when(n < 1024 ** (power + 1), text)
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / 1024**4, 1)))


def stem(name: Column) -> Column:
    """A file name without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def slug(name: Column) -> Column:
    """Lower-case alphanumeric runs joined by hyphens, cut at a hyphen beyond 32 characters."""
    whole = F.btrim(F.regexp_replace(F.lower(stem(name)), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.rtrim(F.regexp_replace(F.substring(whole, 1, 33), "-[^-]*$", ""), F.lit("-"))
    return F.when(F.length(whole) > 32, cut).otherwise(whole)


def job_id(path: Column, mtime: Column) -> Column:
    """12 hex digits of the SHA-256 of path and modification time (a string)."""
    return F.substring(F.sha2(F.concat_ws(":", path, mtime).cast("binary"), 256), 1, 12)


def job_folder(stamp: Column, name: Column, job: Column) -> Column:
    return F.concat_ws("_", stamp, slug(name), F.substring(job, 1, 8))


def output_name(name: Column, style: str = "edition", label: str = "Clean", extension: str = "mkv") -> Column:
    """style edition: a tag {edition-label} after the first (year), else at the end; style suffix: the label itself at the end."""
    base = stem(name)
    if style == "suffix":
        return F.concat(base, F.lit(f"{label}.{extension}"))
    if style != "edition":
        raise ValueError(f"unknown naming style {style!r}: edition or suffix")
    tag = f" {{edition-{label}}}"
    safe = tag.replace("\\", "\\\\").replace("$", "\\$")
    tagged = F.when(base.rlike(r"\(\d{4}\)"), F.regexp_replace(base, r"^(.*?\(\d{4}\))", "$1" + safe)).otherwise(F.concat(base, F.lit(tag)))
    return F.concat(tagged, F.lit(f".{extension}"))


def safe_int(text: Column) -> Column:
    """A whole number, or null for anything else."""
    return text.try_cast("bigint")


def utc_offset(raw: Column) -> Column:
    """struct(offset '+HH:MM', explicit): UTC and false where raw is no offset."""
    pattern = r"^([+-])(\d{2}):?(\d{2})$"
    s = strip(F.coalesce(raw, F.lit("")))
    ok = s.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_replace(s, pattern, "$1$2:$3")).otherwise("+00:00").alias("offset"), ok.alias("explicit"))


def wall_clock(epoch: Column, offset: Column) -> Column:
    """struct(local 'YYYY-MM-DD HH:MM:SS +HHMM', utc '... UTC') of whole seconds since the epoch."""
    minutes = (F.substring(offset, 2, 2).cast("long") * 60 + F.substring(offset, 5, 2).cast("long")) * F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    text = lambda s: F.date_format(F.to_utc_timestamp(F.timestamp_seconds(s), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return F.struct(F.concat(text(epoch + minutes * 60), F.lit(" "), F.replace(offset, F.lit(":"), F.lit(""))).alias("local"), F.concat(text(epoch), F.lit(" UTC")).alias("utc"))


def iso_epoch(text: Column) -> Column:
    """Microseconds since the epoch of an ISO-8601 instant."""
    return F.unix_micros(F.to_timestamp(text))


def interval_expression(intervals: Column) -> Column:
    """between(t,start,end) terms of an array of (start, end) seconds, joined by +."""
    return F.array_join(F.transform(intervals, lambda x: F.format_string("between(t,%.4f,%.4f)", x["start"].cast("double"), x["end"].cast("double"))), "+")
