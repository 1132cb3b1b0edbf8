"""Traded value per KPI and 10-minute bar.

An instrument's value is booked against the highest value booked so far. A lower value is a dip (nothing
booked), unless it is a new level: the volume fell as well (the source restarted its totals), or the dip
lasted beyond its bar.

Inside one bar the baseline has a closed form: it is the running maximum since the last row whose volume
fell. Only the first row of a bar depends on whether a dip was carried in. So each bar is summarised, a
fold over an instrument's bars of the day (at most 144) gives the state each bar starts with, and the
rows of a bar then need nothing but window functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions import tehran
from tapeloom.operators.calendar import DEFAULT_CALENDAR, Calendar
from tapeloom.operators.market import KPI_CLASSES
from tapeloom.params import DEFAULT, Params

BAR = ["ins_code", "day", "bar"]


def kpi_of(cls: Column) -> Column:
    chain = None
    for kpi, classes in KPI_CLASSES.items():
        chain = F.when(cls.isin(classes), kpi) if chain is None else chain.when(cls.isin(classes), kpi)
    return chain


def _valued(accepted: DataFrame) -> DataFrame:
    fell = F.coalesce(F.col("volume") < F.col("volume_before"), F.lit(False))
    rows = accepted.filter(F.col("counted") & F.col("value").isNotNull()).select(
        "seq", "ins_code", "day", kpi_of(F.col("class")).alias("kpi"), F.col("source_time").alias("t"), "value", fell.alias("fell"), "open", "close",
        tehran.floor_10m(F.col("source_time")).alias("bar")).filter(F.col("kpi").isNotNull())
    in_bar = W.partitionBy(*BAR).orderBy("seq")
    rows = rows.withColumn("i", F.row_number().over(in_bar))
    upto, before = in_bar.rowsBetween(W.unboundedPreceding, 0), in_bar.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("level", F.sum(F.when((F.col("i") > 1) & F.col("fell"), 1).otherwise(0)).over(upto))
    return rows.withColumn("top", F.max(F.when(F.col("i") > 1, F.struct("level", "value"))).over(before))


def _starts(rows: DataFrame) -> DataFrame:
    """State at the start of every bar and after its first row."""
    bars = rows.groupBy(*BAR).agg(
        F.max(F.when(F.col("i") == 1, F.struct("value", "fell", "t"))).alias("first"),
        F.max(F.when(F.col("i") > 1, F.struct("level", "value", "t"))).alias("peak"), F.max(F.struct("seq", "value")).alias("last"))
    per_day = bars.groupBy("ins_code", "day").agg(F.sort_array(F.collect_list(F.struct("bar", "first", "peak", "last"))).alias("bars"))
    state = "struct<known: boolean, base: bigint, base_at: timestamp, dip: boolean, bar: timestamp>"
    start_type = "array<struct<bar: timestamp, known: boolean, base: bigint, base_at: timestamp, dip: boolean, dip_bar: timestamp, base1: bigint>>"
    empty = F.struct(
        F.expr(f"CAST(named_struct('known', false, 'base', NULL, 'base_at', NULL, 'dip', false, 'bar', NULL) AS {state})").alias("s"),
        F.expr(f"CAST(array() AS {start_type})").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        s, first, peak = acc["s"], e["first"], e["peak"]
        low = s["known"] & (first["value"] < s["base"])
        stays = low & ~(first["fell"] | s["dip"])
        base1 = F.when(stays, s["base"]).otherwise(first["value"])
        at1 = F.when(stays, s["base_at"]).otherwise(first["t"])
        moved = peak.isNotNull() & ((peak["level"] > 0) | (peak["value"] >= base1))
        base, at = F.when(moved, peak["value"]).otherwise(base1), F.when(moved, peak["t"]).otherwise(at1)
        after = F.struct(F.lit(True).alias("known"), base.alias("base"), at.alias("base_at"), (e["last"]["value"] < base).alias("dip"),
                         e["bar"].alias("bar"))
        start = F.struct(e["bar"].alias("bar"), s["known"].alias("known"), s["base"].alias("base"), s["base_at"].alias("base_at"),
                         s["dip"].alias("dip"), s["bar"].alias("dip_bar"), base1.alias("base1"))
        return F.struct(after.cast(state).alias("s"), F.concat(acc["out"], F.array(start).cast(start_type)).alias("out"))

    starts = F.aggregate("bars", empty, step, lambda acc: acc["out"])
    return per_day.select("ins_code", "day", F.inline(starts))


def booked(accepted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each valued row with the amount it books and the first bar it makes partial (NULL when none)."""
    rows = _valued(accepted)
    out = rows.join(_starts(rows), BAR)
    lead = F.col("i") == 1
    top = F.col("top")
    later = F.when(top.isNull(), F.col("base1")).when(top["level"] > 0, top["value"]).otherwise(F.greatest("base1", top["value"]))
    out = out.withColumn("base_before", F.when(lead, F.col("base")).otherwise(later))
    low = F.coalesce(F.col("value") < F.col("base_before"), F.lit(False))
    out = out.withColumn("dipped_in", F.max(F.when(lead, low)).over(W.partitionBy(*BAR)))
    opening = lead & ~F.col("known")
    amount = F.when(opening | low, F.lit(0)).otherwise(F.col("value") - F.col("base_before"))
    # the baseline dates from an earlier bar on the first row, and until a bar that began with a dip recovers
    carried = F.col("known") & (lead | ((F.col("base_before") == F.col("base")) & (F.col("base1") == F.col("base"))
                                       & F.coalesce((top["level"] == 0) & (top["value"] < F.col("base1")), F.lit(True)) & F.col("dipped_in")))
    begin, end = F.greatest("base_at", "open"), F.least("t", "close")
    gap = (carried & (F.col("value") > F.col("base_before")) & (tehran.seconds_between(begin, end) > p.gap_after)
           & (tehran.floor_10m(end) > tehran.floor_10m(begin)))
    dip_in = lead & F.coalesce(F.col("dip"), F.lit(False))
    mark = F.least(F.when(low | dip_in, F.col("bar")), F.when(dip_in & low, F.col("dip_bar")), F.when(gap, tehran.floor_10m(begin)))
    return out.select("seq", "ins_code", "kpi", "day", "bar", amount.cast("bigint").alias("amount"), mark.alias("mark_from"),
                      F.when(opening & (F.col("value") > 0), F.col("bar")).alias("late_until"))


def value_series(accepted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(kpi, day, bar): value booked (NULL when no snapshot of the group was seen in the bar) and partial."""
    rows = booked(accepted, p)
    sums = rows.groupBy("kpi", "day", "bar").agg(F.sum("amount").alias("value"))
    marks = (rows.filter(F.col("mark_from").isNotNull()).select("kpi", "day", "mark_from", F.col("bar").alias("mark_to")).distinct()
             .select("kpi", "day", F.explode(F.expr("sequence(mark_from, mark_to, interval 10 minutes)")).alias("bar")).distinct()
             .withColumn("marked", F.lit(True)))
    late = rows.groupBy("kpi", "day").agg(F.max("late_until").alias("late_until"))
    return (sums.join(marks, ["kpi", "day", "bar"], "full").join(late, ["kpi", "day"])
            .withColumn("partial", F.coalesce("marked", F.lit(False)) | F.coalesce(F.col("bar") <= F.col("late_until"), F.lit(False)))
            .select("kpi", "day", "bar", "value", "partial", "late_until"))


def series_bars(series: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT) -> DataFrame:
    """Gap-free axis from the first to the last observed bar (from the class open after a late start), newest
    ``series_bars`` bars; a bar nobody was seen in has a NULL value."""
    span = series.groupBy("kpi", "day").agg(
        F.min(F.when(F.col("value").isNotNull(), F.col("bar"))).alias("first"), F.max(F.when(F.col("value").isNotNull(), F.col("bar"))).alias("last"),
        F.max("late_until").alias("late_until")).filter(F.col("first").isNotNull())
    first_open = None
    for kpi, classes in KPI_CLASSES.items():
        for c in classes:
            span = calendar.with_session(span.withColumn("_class", F.lit(c)), F.col("day"), f"{c}_", "_class")
        opens = [F.col(f"{c}_open") for c in classes]
        earliest = F.least(*opens) if len(opens) > 1 else opens[0]
        first_open = F.when(F.col("kpi") == kpi, earliest) if first_open is None else first_open.when(F.col("kpi") == kpi, earliest)
    start = F.when(F.col("late_until").isNotNull(), F.least("first", tehran.floor_10m(first_open))).otherwise(F.col("first"))
    from_last = F.expr(f"last - make_dt_interval(0, 0, {10 * (p.series_bars - 1)}, 0)")
    axis = span.select("kpi", "day", "late_until", F.greatest(start, from_last).alias("from"), "last").select(
        "kpi", "day", "late_until", F.explode(F.expr("sequence(`from`, last, interval 10 minutes)")).alias("bar"))
    return (axis.join(series.select("kpi", "day", "bar", "value", "partial"), ["kpi", "day", "bar"], "left")
            .select("kpi", "day", "bar", "value",
                    F.coalesce("partial", F.coalesce(F.col("bar") <= F.col("late_until"), F.lit(False))).alias("partial")))
