"""Column helpers for the reference's scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"   # fixed: the reference's order time format


def utc_text(ts: Column | str) -> Column:
    """Timestamp rendered as ``YYYY-MM-DDTHH:MM:SSZ`` (session time zone is UTC)."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, UTC_TEXT)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock (timestamp_ntz) value.

    Independent of the session time zone, so ids and buckets are the same
    in every session (and monotone across daylight-saving changes).
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def history_id(key: Column | str, ts: Column | str, seq: Column | str) -> Column:
    """``key _ epoch-micros _ sequence``: unique even for two changes at one instant."""
    k = F.col(key) if isinstance(key, str) else key
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.concat_ws("_", k.cast("string"), epoch_micros(ts).cast("string"), s.cast("string"))


def distinct_from(a: Column | str, b: Column | str) -> Column:
    """SQL ``a IS DISTINCT FROM b``."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return ~a.eqNullSafe(b)


def to_int_column(dec: Column | str) -> Column:
    """Numeric stored into an INT column: round half away from zero, then cast."""
    c = F.col(dec) if isinstance(dec, str) else dec
    return F.round(c, 0).cast("int")


def blank(c: Column | str) -> Column:
    """Go zero-value test for strings: NULL or empty counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def non_positive(c: Column | str) -> Column:
    """Go zero-value test for numbers: NULL (absent -> 0) or <= 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0)) <= 0
