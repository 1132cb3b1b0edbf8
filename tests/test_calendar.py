"""Sessions, windows and the calendar file."""

from __future__ import annotations

import json
from datetime import date, timedelta

from helpers import at
from pyspark.sql import functions as F

from tapeloom.functions import tehran
from tapeloom.operators import calendar as cal

WEEK = ["sat", "sun", "mon", "tue", "wed"]


def local(ts):
    return None if ts is None else (ts + timedelta(hours=3, minutes=30)).strftime("%H:%M")


def bounds(spark, calendar, cls, day):
    df = spark.createDataFrame([(cls, date.fromisoformat(day))], "class string, day date")
    r = calendar.with_session(df, F.col("day")).first()
    return (local(r.pre_open), local(r.open), local(r.close)) if r.open else None


def test_class_hours(spark):
    c = cal.DEFAULT_CALENDAR
    assert bounds(spark, c, "stock", "2026-09-26") == ("08:45", "09:00", "12:30")
    assert bounds(spark, c, "gold", "2026-09-26") == ("11:45", "12:00", "18:00")
    assert bounds(spark, c, "unknown", "2026-09-26") == ("08:25", "08:30", "18:00")
    assert bounds(spark, c, "stock", "2026-10-01") is None and bounds(spark, c, "stock", "2026-10-02") is None
    assert bounds(spark, c, "nonsense", "2026-09-26") is None


def test_calendar_file(spark, tmp_path):
    """Two dated rules, a holiday, and an instrument map with a default class."""
    f = {"default_class": "stock", "classes": {
        "stock": {"label_fa": "x", "rules": [
            {"effective_from": "2025-01-01", "days": WEEK, "pre_open": "08:45", "open": "09:00", "close": "12:30", "verified": True},
            {"effective_from": "2026-01-01", "days": ["Sat", "sun"], "pre_open": "08:30", "open": "08:45", "close": "13:00", "verified": False}]},
        "gold": {"rules": [{"effective_from": "2025-01-01", "days": WEEK, "pre_open": "11:45", "open": "12:00", "close": "18:00", "verified": True}]}},
        "instruments": {"G": "gold"}, "holidays": [{"date": "2025-06-01", "name": "h", "verified": True}]}
    path = tmp_path / "sessions.json"
    path.write_text(json.dumps(f))
    dims = cal.load_calendar(spark, str(path))
    c = dims.calendar()
    assert c.default_class == "stock"
    assert bounds(spark, c, "stock", "2024-12-28") is None
    assert bounds(spark, c, "stock", "2025-12-31") == ("08:45", "09:00", "12:30")
    assert bounds(spark, c, "stock", "2026-01-03") == ("08:30", "08:45", "13:00")
    assert bounds(spark, c, "stock", "2026-01-05") is None  # Monday is not in the newer rule
    assert bounds(spark, c, "unknown", "2026-01-05") == ("11:45", "12:00", "18:00")
    assert bounds(spark, c, "gold", "2025-06-01") is None
    days = spark.createDataFrame([(date(2025, 6, 2),), (date(2026, 1, 3),)], "day date")
    got = {r.day: (r.verified, local(r.open), local(r.close)) for r in cal.union_session(days, c).collect()}
    assert got == {date(2025, 6, 2): (True, "09:00", "18:00"), date(2026, 1, 3): (False, "08:45", "18:00")}
    assert {r.day: r.expected for r in c.previous_trading_day(days).collect()} == {date(2025, 6, 2): date(2025, 5, 31), date(2026, 1, 3): date(2025, 12, 31)}
    opens = {r.day: [local(o) for o in r.opens] for r in c.opens(days).collect()}
    assert opens == {date(2025, 6, 2): ["09:00", "12:00"], date(2026, 1, 3): ["08:45", "12:00"]}
    rows = spark.createDataFrame([("G",), ("other",)], "ins_code string")
    assert {r.ins_code: r["class"] for r in cal.with_class(rows, dims.instruments, c.default_class).collect()} == {"G": "gold", "other": "stock"}


def test_windows(spark):
    """Session-relative windows count backwards before the open; closed days follow the clock."""
    o = at("2026-09-26", "09:05:00")
    rows = [(o, at("2026-09-26", t)) for t in ("09:05:00", "09:14:59", "09:15:00", "09:04:59", "08:55:00")] + [(None, at("2026-10-01", "10:19:00"))]
    df = spark.createDataFrame(rows, "open timestamp, ts timestamp")
    got = [local(r.w) for r in df.select(tehran.window_start(F.col("open"), F.col("ts")).alias("w")).collect()]
    assert got == ["09:05", "09:05", "09:15", "08:55", "08:55", "10:10"]


def test_dst_start_day(spark):
    """Local midnight does not exist on this day; the day starts at the instant the clock jumps to."""
    df = spark.createDataFrame([(date(2021, 3, 22),)], "day date")
    assert str(df.select(tehran.day_start(F.col("day")).alias("t")).first().t) == "2021-03-21 20:30:00"
