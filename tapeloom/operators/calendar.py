"""Trading sessions: dated rules per class, holidays and the instrument -> class map.

Rules and holidays are a few dozen configuration rows, so a session is a plain CASE expression
(newest rule in effect, weekday allowed, not a holiday): every time rule costs no join and no shuffle,
in batch and in streaming alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import tehran

UNKNOWN = "unknown"
# Classes with aggregates of their own, in display order.
CLASSES = ["stock", "equity_etf", "gold", "silver", "fixed_income", "other_fund"]
# Weekday names of the calendar file, numbered as Spark's weekday() (Monday = 0).
WEEKDAYS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}


@dataclass(frozen=True)
class Rule:
    cls: str
    effective_from: date
    days: tuple[str, ...]
    pre_open: str
    open: str
    close: str
    verified: bool = False


# (pre_open, open, close) in seconds after Tehran midnight, and whether the rule is verified.
Hours = tuple[int, int, int, bool]


def _seconds(hm: str) -> int:
    h, m = hm.split(":")
    return int(h) * 3600 + int(m) * 60


@dataclass(frozen=True)
class Calendar:
    rules: tuple[Rule, ...]
    holidays: tuple[date, ...] = ()
    default_class: str = UNKNOWN

    def class_names(self) -> list[str]:
        return sorted({r.cls for r in self.rules})

    def _in_force(self, cls: str, day: date) -> Rule | None:
        dated = [r for r in self.rules if r.cls == cls and r.effective_from <= day]
        return max(dated, key=lambda r: r.effective_from) if dated else None

    def timetable(self, cls: str) -> list[tuple[date, dict[Hours, list[int]]]]:
        """Newest first: (effective from, hours -> weekdays). Class unknown spans every class trading that
        weekday and is verified only if all of them are."""
        members = self.class_names() if cls == UNKNOWN else [cls]
        out = []
        for start in sorted({r.effective_from for r in self.rules if r.cls in members}, reverse=True):
            hours: dict[Hours, list[int]] = {}
            for name, number in WEEKDAYS.items():
                trading = [r for r in (self._in_force(c, start) for c in members) if r and name in r.days]
                if trading:
                    h = (min(_seconds(r.pre_open) for r in trading), min(_seconds(r.open) for r in trading),
                         max(_seconds(r.close) for r in trading), all(r.verified for r in trading))
                    hours.setdefault(h, []).append(number)
            out.append((start, hours))
        return out

    def _hours_sql(self, cls: str, day: str) -> str:
        dated = []
        for start, hours in self.timetable(cls):
            by_weekday = " ".join(
                f"WHEN weekday({day}) IN ({', '.join(map(str, days))}) THEN named_struct('pre_open', {h[0]}, 'open', {h[1]}, "
                f"'close', {h[2]}, 'verified', {str(h[3]).lower()})" for h, days in hours.items())
            dated.append(f"WHEN {day} >= DATE'{start}' THEN CASE {by_weekday} END")
        return f"CASE {' '.join(dated)} END"

    def hours_sql(self, cls: str, day: str) -> str:
        """SQL struct of second offsets (pre_open, open, close, verified) of class column ``cls`` on date
        column ``day``; NULL when the class is closed."""
        by_class = " ".join(f"WHEN '{c}' THEN {self._hours_sql(c, day)}" for c in [*self.class_names(), UNKNOWN])
        chosen = f"(CASE {cls} {by_class} END)"
        if not self.holidays:
            return chosen
        off = ", ".join(f"DATE'{d}'" for d in self.holidays)
        return f"(CASE WHEN {day} NOT IN ({off}) THEN {chosen} END)"

    def with_session(self, df: DataFrame, day: Column, prefix: str = "", cls: str = "class") -> DataFrame:
        """Add pre_open, open, close and verified of each row's class on ``day``."""
        h, start, on = f"_{prefix}hours", f"_{prefix}start", f"_{prefix}on"
        out = df.withColumn(on, day).withColumns({h: F.expr(self.hours_sql(cls, on)), start: tehran.day_start(F.col(on))})
        return out.withColumns({
            f"{prefix}pre_open": tehran.plus_seconds(F.col(start), F.col(h)["pre_open"]),
            f"{prefix}open": tehran.plus_seconds(F.col(start), F.col(h)["open"]),
            f"{prefix}close": tehran.plus_seconds(F.col(start), F.col(h)["close"]),
            f"{prefix}verified": F.col(h)["verified"],
        }).drop(h, start, on)

    def trading_at(self, df: DataFrame, instant: str, cls: str = "class") -> DataFrame:
        """Add ``trading``: the class trades at the instant (unknown: any class does)."""
        def inside(c: str) -> str:
            h = self._gated(c, "_day")
            return f"coalesce(_sec >= {h}.open AND _sec < {h}.close, false)"

        each = " ".join(f"WHEN '{c}' THEN {inside(c)}" for c in self.class_names())
        anyone = " OR ".join(inside(c) for c in self.class_names())
        on = df.withColumn("_day", tehran.trading_day(F.col(instant)))
        on = on.withColumn("_sec", (F.unix_micros(instant) - F.unix_micros(tehran.day_start(F.col("_day")))) / 1e6)
        return on.withColumn("trading", F.expr(f"CASE {cls} {each} WHEN '{UNKNOWN}' THEN {anyone} ELSE false END")).drop("_day", "_sec")

    def opens(self, df: DataFrame, day: str = "day") -> DataFrame:
        """Add the sorted distinct class opens of a day (empty when closed)."""
        rows = ", ".join(f"{self._gated(c, day)}.open" for c in self.class_names())
        return df.withColumn("_start", tehran.day_start(F.col(day))).withColumn("opens", F.expr(
            f"transform(array_sort(array_distinct(array_compact(array({rows})))), "
            "s -> timestamp_micros(unix_micros(_start) + s * 1000000L))")).drop("_start")

    def _gated(self, cls: str, day: str) -> str:
        return self.hours_sql(f"'{cls}'", day) if self.holidays else f"({self._hours_sql(cls, day)})"

    def previous_trading_day(self, df: DataFrame, day: str = "day", look_back: int = 21) -> DataFrame:
        """Add ``expected``: the last day any class traded within ``look_back`` days before; NULL when none."""
        return df.withColumn("expected", F.expr(
            f"try_element_at(filter(sequence(date_sub({day}, 1), date_sub({day}, {look_back}), interval -1 day), "
            f"d -> ({self._gated(UNKNOWN, 'd')}).open IS NOT NULL), 1)"))


_ALL_WEEK = ("sat", "sun", "mon", "tue", "wed")
# Owner-provided hours, all unverified.
DEFAULT_CALENDAR = Calendar(rules=(
    Rule("stock", date(2000, 1, 1), _ALL_WEEK, "08:45", "09:00", "12:30"),
    Rule("equity_etf", date(2000, 1, 1), _ALL_WEEK, "08:45", "09:00", "12:30"),
    Rule("fixed_income", date(2000, 1, 1), _ALL_WEEK, "08:25", "08:30", "15:00"),
    Rule("gold", date(2000, 1, 1), _ALL_WEEK, "11:45", "12:00", "18:00"),
    Rule("silver", date(2000, 1, 1), _ALL_WEEK, "11:45", "12:00", "18:00"),
    Rule("other_fund", date(2000, 1, 1), _ALL_WEEK, "08:45", "09:00", "12:30"),
))

CALENDAR_FILE = (
    "default_class string, instruments_verified boolean, "
    "classes map<string, struct<label_fa: string, rules: array<struct<effective_from: string, days: array<string>, "
    "pre_open: string, open: string, close: string, verified: boolean, source: string>>>>, "
    "instruments map<string, string>, holidays array<struct<date: string, name: string, verified: boolean>>"
)


@dataclass(frozen=True)
class CalendarDims:
    rules: DataFrame
    holidays: DataFrame
    instruments: DataFrame
    settings: DataFrame

    def calendar(self) -> Calendar:
        """Rules and holidays as expressions (a handful of configuration rows)."""
        rules = tuple(Rule(r["class"], r.effective_from, tuple(r.days), r.pre_open, r.open, r.close, bool(r.verified))
                      for r in self.rules.collect())
        holidays = tuple(sorted({r.date for r in self.holidays.collect()}))
        default = self.settings.first().default_class
        return Calendar(rules, holidays, default or UNKNOWN)


def load_calendar(spark: SparkSession, path: str) -> CalendarDims:
    f = spark.read.schema(CALENDAR_FILE).option("multiLine", True).json(path)
    per_class = f.select(F.explode("classes").alias("class", "c"))
    rules = per_class.select("class", F.explode("c.rules").alias("r")).select(
        "class", F.to_date("r.effective_from").alias("effective_from"),
        F.transform("r.days", F.lower).alias("days"), "r.pre_open", "r.open", "r.close",
        F.coalesce("r.verified", F.lit(False)).alias("verified"))
    holidays = f.select(F.explode("holidays").alias("h")).select(
        F.to_date("h.date").alias("date"), "h.name", F.coalesce("h.verified", F.lit(False)).alias("verified"))
    instruments = f.select(F.explode("instruments").alias("ins_code", "class"))
    settings = f.select(F.coalesce("default_class", F.lit(UNKNOWN)).alias("default_class"), "instruments_verified")
    return CalendarDims(rules, holidays, instruments, settings)


def write_calendar(spark: SparkSession, calendar: Calendar, path: str, days: DataFrame | None = None) -> None:
    """``calendar`` as the file that ``load_calendar`` reads; with ``days``, only the holidays among them are written."""
    holidays = spark.createDataFrame([(d,) for d in calendar.holidays], "date date")
    if days is not None:
        holidays = holidays.join(days.select(F.col("day").alias("date")).distinct(), "date", "left_semi")
    rules = spark.createDataFrame([(r.cls, r.effective_from, list(r.days), r.pre_open, r.open, r.close, r.verified) for r in calendar.rules],
                                  "class string, effective_from date, days array<string>, pre_open string, open string, close string, verified boolean")
    rule = F.struct(F.date_format("effective_from", "yyyy-MM-dd").alias("effective_from"), "days", "pre_open", "open", "close", "verified")
    per_class = rules.groupBy("class").agg(F.struct(F.collect_list(rule).alias("rules")).alias("c"))
    classes = per_class.agg(F.map_from_entries(F.collect_list(F.struct("class", "c"))).alias("classes"))
    free = holidays.agg(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.lit("").alias("name"), F.lit(True).alias("verified"))).alias("holidays"))
    # one row each: a calendar is a handful of rules
    out = classes.withColumn("one", F.lit(1)).join(free.withColumn("one", F.lit(1)), "one").select(
        F.lit(calendar.default_class).alias("default_class"), "classes", "holidays")
    out.coalesce(1).write.mode("overwrite").json(path)


def with_class(df: DataFrame, instruments: DataFrame, default_class: str = UNKNOWN) -> DataFrame:
    """Instrument -> class; unmapped instruments get the default."""
    dim = instruments.select("ins_code", F.col("class").alias("_mapped"))
    return df.join(dim, "ins_code", "left").withColumn(
        "class", F.coalesce("_mapped", F.lit(default_class))).drop("_mapped")


def sessions(days: DataFrame, calendar: Calendar, classes: Iterable[str] | None = None) -> DataFrame:
    """(class, day) -> session bounds for every class trading that day; ``days`` has one ``day`` column."""
    names = F.array(*[F.lit(c) for c in (classes or calendar.class_names())])
    rows = days.select("day", F.explode(names).alias("class"))
    return calendar.with_session(rows, F.col("day")).filter(F.col("open").isNotNull())


def union_session(days: DataFrame, calendar: Calendar) -> DataFrame:
    return sessions(days, calendar, [UNKNOWN])
