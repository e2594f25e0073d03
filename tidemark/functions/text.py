"""Words and digests of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words: all but letters, marks and digits.
BREAKS = r"[^\p{L}\p{M}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words; null gives no words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def times_of(words: Column, term: str) -> Column:
    return (F.size(words) - F.size(F.array_remove(words, term))).cast("long")


def micros(ts: Column) -> Column:
    """A timestamp as text, to the microsecond, alike in all time zones for timestamps without one."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def fixed(value: Column) -> Column:
    """A number as text in millionths, so that it reads the same everywhere."""
    return F.coalesce(F.round(value * 1_000_000).cast("long").cast("string"), F.lit(""))


def receipt(*parts: Column) -> Column:
    """A digest of a row: each part as text after its length in bytes, null as a dash, so no two different rows are written alike."""
    text = [p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(",", *(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)
