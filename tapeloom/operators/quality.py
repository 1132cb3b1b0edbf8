"""Data-quality issues: one row per instrument, code and occurrence, at the ingest time of the snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rules, tehran
from tapeloom.operators.calendar import DEFAULT_CALENDAR, Calendar
from tapeloom.params import DEFAULT, Params
from tapeloom.schemas import TOTALS

# Issue codes.
STALE = "STALE"
INCOMPLETE = "INCOMPLETE"
OUT_OF_ORDER = "OUT_OF_ORDER"
CUMULATIVE_DECREASE = "CUMULATIVE_DECREASE"
SIDE_MISMATCH = "SIDE_MISMATCH"
TIME_ESTIMATED = "SOURCE_TIME_ESTIMATED"
UNDECODABLE = "UNDECODABLE"
DAY_START_MISSED = "DAY_START_MISSED"
PREV_DAY_CARRYOVER = "PREV_DAY_CARRYOVER"

ONCE_PER_DAY = [TIME_ESTIMATED, PREV_DAY_CARRYOVER]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("0")) for x in parts])


def _utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _clock(ts: Column, pattern: str = "HH:mm:ss") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tehran.ZONE), pattern)


def _duration(seconds: Column) -> Column:
    """1h2m3s, 2m3s or 3s."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    tail = _text(s.cast("bigint"), "s")
    return (F.when(seconds >= 3600, _text(h, "h", m, "m", tail)).when(seconds >= 60, _text(m, "m", tail)).otherwise(tail))


Rule = tuple[Column, Column]


def _issue(code: str, when: Column, detail: Column, day: Column | None = None) -> Rule:
    """(condition, issue struct)."""
    return when, F.struct(F.lit(code).alias("code"), detail.alias("detail"), (F.lit(None).cast("date") if day is None else day).alias("once_on"))


def _row_issues(p: Params) -> list[Rule]:
    c = F.col
    lag = F.round(tehran.seconds_between(c("source_time"), c("ingest_time"))).cast("bigint")
    trading = F.coalesce((c("ingest_time") >= c("in_open")) & (c("ingest_time") < c("in_close")), F.lit(False))
    ingest_day = tehran.trading_day(c("ingest_time"))
    late_by = tehran.seconds_between(c("source_time"), c("ingest_time"))
    now = _clock(c("source_time"))
    totals = _text("day volume ", c("volume"), ", value ", c("value"), ", trades ", c("trade_count"))
    pre_open = _text("pre-open snapshot at ", now, " shows ", totals, " before the ", c("class"), " open (",
                     _clock(c("open"), "HH:mm"), "): previous-day totals, not a baseline")
    repeat = _text("snapshot at ", now, " repeats the last totals of ", c("ref_day"), " (volume ", c("volume"), ", value ", c("value"),
                   "): the source has not reset its day totals; not a baseline")
    why = F.when(c("active"), _text("already has ", totals, ": trades before it are not counted")).otherwise(
        _text("was taken after the ", c("class"), " session open (", _clock(c("open"), "HH:mm"), "), so completeness cannot be proven"))
    late = _text("first accepted snapshot of ", c("day"), " at ", now, " ", why, "; day totals and this 10-minute window are partial")
    decreases = [
        _issue(CUMULATIVE_DECREASE, (c("outcome") == "rebaseline") & (c(f"d_{t}") < 0), _text(name, " decreased by ", -c(f"d_{t}")))
        for t, name in TOTALS.items()]
    mismatch = _text("buy ", c("d_ind_buy_vol"), "+", c("d_inst_buy_vol"), ", sell ", c("d_ind_sell_vol"), "+", c("d_inst_sell_vol"),
                     ", volume ", c("d_volume"))
    return [
        _issue(TIME_ESTIMATED, c("source_time_estimated"), F.lit("source provided no timestamp; ingest time used"), ingest_day),
        _issue(STALE, ~c("source_time_estimated") & trading & (late_by > p.stale_after),
               _text("lag ", _duration(lag), " > ", _duration(F.lit(p.stale_after)))),
        _issue(INCOMPLETE, ~c("eligible"), _text("missing [", F.array_join(rules.missing_flow_fields(), " "), "]")),
        _issue(OUT_OF_ORDER, c("outcome") == "earlier_day",
               _text("source time ", _utc(c("source_time")), " is on an earlier trading day than ", _utc(c("prev.source_time")))),
        _issue(OUT_OF_ORDER, c("outcome") == "out_of_order",
               _text("source time ", _utc(c("source_time")), " not after ", _utc(c("prev.source_time")))),
        _issue(PREV_DAY_CARRYOVER, c("outcome") == "carryover", F.when(c("carry") == "pre_open", pre_open).otherwise(repeat), c("day")),
        _issue(DAY_START_MISSED, c("late"), late),
        *decreases,
        _issue(SIDE_MISMATCH, (c("outcome") == "rebaseline") & ~c("decreased"), mismatch),
    ]


def all_occurrences(accepted: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT, keep: list[str] | None = None) -> DataFrame:
    """Every rule that fired on every row, before the once-per-day codes are reduced; columns ``keep`` stay."""
    rows = calendar.with_session(accepted, tehran.trading_day(F.col("ingest_time")), "in_")
    fired = _row_issues(p)
    # most rows are clean: they leave before any issue is built
    suspect = rows.filter(rules.any_of([F.coalesce(when, F.lit(False)) for when, _ in fired]))
    every = F.inline(F.array(*[F.when(when, issue) for when, issue in fired]))
    return suspect.select("seq", "ins_code", F.col("ingest_time").alias("at"), *(keep or []), every).filter(F.col("code").isNotNull())


def once_per_day(occurrences: DataFrame, codes: list[str] = ONCE_PER_DAY, keep_day: bool = False) -> DataFrame:
    """First occurrence per instrument, code and day. A minimum per group, so hot groups combine map-side."""
    first = F.min(F.struct("seq", "at", "detail")).alias("f")
    return (occurrences.filter(F.col("code").isin(codes)).groupBy("ins_code", "code", "once_on").agg(first)
            .select("f.seq", "ins_code", "code", "f.detail", "f.at", *(["once_on"] if keep_day else [])))


def issues(accepted: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT) -> DataFrame:
    """The issue table: (seq, ins_code, code, detail, at), from one pass over the rows.

    Codes reported once a day form one group per instrument and day; every other issue is a group of its own.
    """
    every = all_occurrences(accepted, calendar, p)
    own = F.when(F.col("once_on").isNull(), F.struct("seq", "detail")).alias("own")
    first = F.min(F.struct("seq", "at", "detail")).alias("f")
    return every.groupBy("ins_code", "code", "once_on", own).agg(first).select("f.seq", "ins_code", "code", "f.detail", "f.at")


def issue_counts(issue_rows: DataFrame) -> DataFrame:
    """Issues per instrument and day; estimated source times are a latency label, not an issue.

    ``ins_code`` is empty for issues without an instrument.
    """
    return (issue_rows.filter(F.col("code") != TIME_ESTIMATED)
            .groupBy(F.coalesce("ins_code", F.lit("")).alias("ins_code"), tehran.trading_day(F.col("at")).alias("day"))
            .agg(F.count(F.lit(1)).alias("issues")))
