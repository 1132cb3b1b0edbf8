"""Tehran clock rules as column expressions (session time zone must be UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Tehran"
WINDOW_US = 600_000_000


def trading_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def day_start(day: Column) -> Column:
    """00:00 Tehran of a date, as an instant."""
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def floor_10m(ts: Column) -> Column:
    local = F.unix_micros(F.from_utc_timestamp(ts, ZONE))
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(local, F.lit(WINDOW_US)))


def window_start(open_: Column, ts: Column) -> Column:
    """Session-relative 10-minute window, counting backwards before the open; Tehran clock on closed days."""
    us = F.unix_micros(ts)
    relative = F.timestamp_micros(us - F.pmod(us - F.unix_micros(open_), F.lit(WINDOW_US)))
    return F.when(open_.isNull(), floor_10m(ts)).otherwise(relative)


def trading_overlap(open_: Column, close: Column, start: Column, end: Column) -> Column:
    """Seconds of [start, end) inside the session; 0 on a closed day."""
    inside = F.unix_micros(F.least(end, close)) - F.unix_micros(F.greatest(start, open_))
    return F.when(open_.isNull(), F.lit(0.0)).otherwise(F.greatest(inside, F.lit(0)) / 1e6)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6
