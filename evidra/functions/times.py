"""Time rules.  Timestamps are typed; ``lexical`` helpers compare the original strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    """The first 19 characters as a UTC timestamp; shorter or malformed text gives null."""
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def floor_minute(t: Column) -> Column:
    return F.date_trunc("minute", t)


def shift_minutes(t: Column, n: int | Column) -> Column:
    """Minutes added to the floored minute: seconds are dropped."""
    n = F.lit(n) if isinstance(n, int) else n
    return floor_minute(t) + F.make_dt_interval(F.lit(0), F.lit(0), n)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a's minute to b's minute."""
    return F.floor((F.unix_timestamp(floor_minute(b)) - F.unix_timestamp(floor_minute(a))) / 60).cast("long")


def lag_seconds(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b))


def hhmm(t: Column) -> Column:
    return F.date_format(t, "HH:mm")


def iso_second(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def replay_key(c: Column) -> Column:
    """(base, nanos) of an ISO time with Z and up to nine fractional digits; null if malformed."""
    ok = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$")
    fraction = F.regexp_extract(c, r"\.([0-9]+)Z$", 1)
    return F.when(ok, F.struct(F.substring(c, 1, 19).alias("base"), F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("int").alias("nanos")))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Closed at both ends; a missing window overlaps nothing."""
    return F.coalesce((start <= other_end) & (other_start <= end), F.lit(False))
