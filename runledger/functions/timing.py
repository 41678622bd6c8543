"""Microsecond arithmetic.  Times are bigint microseconds since 1970 (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def elapsed_ms(start_us: Column, end_us: Column) -> Column:
    return (end_us - start_us) / F.lit(1000.0)


def elapsed_s(start_us: Column, end_us: Column) -> Column:
    return (end_us - start_us) / F.lit(1_000_000.0)


def present(time_us: Column) -> Column:
    """Job times of zero count as missing."""
    return F.nullif(time_us, F.lit(0))
