"""Acceptance of snapshots: which rows become baselines, which pairs become intervals.

Per instrument, in arrival order, an accepted row is one whose source time exceeds the source time of
every earlier complete, non-carryover row. So acceptance, and the predecessor each row is compared with,
follow from one running maximum of a struct led by the source time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions import rules, tehran
from tapeloom.operators.calendar import DEFAULT_CALENDAR, Calendar
from tapeloom.operators.ordered import Prefix, carried_in, chunk_of, chunk_totals, within_chunk
from tapeloom.params import DEFAULT, Params
from tapeloom.runtime import stage
from tapeloom.schemas import TOTALS

# Columns the engine needs; the order book never travels through a shuffle.
ENGINE_COLUMNS = [
    "seq", "ins_code", "symbol", "class", "source_time", "ingest_time", "source_time_estimated", "price_last",
    "trade_count", "volume", "value", "ind_buy_vol", "ind_sell_vol", "inst_buy_vol", "inst_sell_vol",
    "ind_buy_count", "ind_sell_count",
]
# What a row keeps of its predecessor.
PREV_COLUMNS = ["ingest_time", "price_last", *TOTALS]


def not_future(p: Params = DEFAULT) -> Column:
    """The row's source time is plausible, so it may move the trading day."""
    return F.unix_micros("source_time") <= F.unix_micros("ingest_time") + p.future_guard * 1_000_000


def day_rolls(snaps: DataFrame, p: Params = DEFAULT, begun: DataFrame | None = None) -> DataFrame:
    """Arrival ranges of the market-wide trading day: (day, roll_seq, next_seq, last_seq).

    A day begins at its first plausible row, if it is later than every day begun before. One row per
    trading day of the data. ``begun`` holds the day already current before these snapshots.
    """
    firsts = snaps.groupBy(tehran.trading_day(F.col("source_time")).alias("day")).agg(
        F.min(F.when(not_future(p), F.col("seq"))).alias("roll_seq"), F.max("seq").alias("max_seq"))
    if begun is not None:
        before = F.lit(-1).cast("bigint")
        firsts = firsts.join(begun.select("day"), "day", "left_anti").unionByName(
            begun.select("day", before.alias("roll_seq"), before.alias("max_seq")))
    by_arrival = W.orderBy(F.col("roll_seq").asc_nulls_last(), "day")
    everything = W.partitionBy(F.lit(1))
    ranked = firsts.withColumns({
        "latest": F.max(F.when(F.col("roll_seq").isNotNull(), F.col("day"))).over(
            by_arrival.rowsBetween(W.unboundedPreceding, -1)),
        "last_seq": F.max("max_seq").over(everything)})
    begun = ranked.filter(F.col("roll_seq").isNotNull() & (F.col("latest").isNull() | (F.col("day") > F.col("latest"))))
    return begun.select("day", "roll_seq", F.lead("roll_seq").over(W.orderBy("roll_seq")).alias("next_seq"), "last_seq")


def seen_totals(snaps: DataFrame, rolls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per instrument and day: the last totals shown while that day was the market's current day."""
    shown = snaps.filter(not_future(p) & F.col("volume").isNotNull() & F.col("value").isNotNull()).select(
        "ins_code", "seq", "volume", "value", "trade_count", tehran.trading_day(F.col("source_time")).alias("day"))
    current = shown.join(rolls.select("day", "next_seq"), "day").filter(
        F.col("next_seq").isNull() | (F.col("seq") < F.col("next_seq")))
    return newest_totals(current)


def newest_totals(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("seq", "volume", "value", "trade_count")).alias("t")
    return rows.groupBy("ins_code", "day").agg(last).select("ins_code", "day", "t.*")


def carried_totals(seen: DataFrame, keep_days: int) -> DataFrame:
    """Add the totals each (instrument, day) hands on: an all-zero day hands on the active ones before it."""
    by_day = W.partitionBy("ins_code").orderBy("day")
    far = F.coalesce(F.datediff("day", F.lag("day").over(by_day)) > keep_days, F.lit(False)).cast("int")
    in_run = W.partitionBy("ins_code", "run").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    totals = F.struct("volume", "value", "trade_count")
    active = rules.totals_active(F.col("volume"), F.col("value"), F.col("trade_count"))
    return (seen.withColumn("run", F.sum(far).over(by_day.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("kept", F.coalesce(F.last(F.when(active, totals), ignorenulls=True).over(in_run), totals))
            .withColumn("next_day", F.lead("day").over(by_day)))


def prev_day_reference(snaps: DataFrame, p: Params = DEFAULT, rolls: DataFrame | None = None,
                       initial: DataFrame | None = None) -> DataFrame:
    """(ins_code, day) -> the instrument's last totals of earlier days, for every day the market rolled to.

    ``initial`` (ins_code, day, seq, volume, value, trade_count) holds totals seen in an earlier run.
    """
    rolls = stage(day_rolls(snaps, p), "rolls") if rolls is None else rolls
    seen = seen_totals(snaps, rolls, p)
    if initial is not None:
        seen = newest_totals(seen.unionByName(initial))
    seen = stage(seen, "seen")
    handed = carried_totals(seen, p.keep_days)
    last = F.least(F.coalesce("next_day", F.date_add("day", p.keep_days)), F.date_add("day", p.keep_days))
    spans = handed.select("ins_code", "kept", F.col("day").alias("seen_day"),
                          F.explode(F.sequence(F.date_add("day", 1), last)).alias("day"))
    days = seen.select("day").distinct().withColumn("shown", F.col("day"))
    order = W.orderBy("day")
    rolled = rolls.select("day").join(days, "day", "full").withColumn(
        "ref_day", F.last("shown", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rolled = rolls.select("day").join(rolled.select("day", "ref_day"), "day")
    return spans.join(rolled, "day").select(
        "ins_code", "day", "ref_day", F.col("kept.volume").alias("ref_volume"), F.col("kept.value").alias("ref_value"),
        F.col("kept.trade_count").alias("ref_trades"), "seen_day")


def _references_by_chunk(cut: DataFrame, rolls: DataFrame, reference: DataFrame, p: Params) -> DataFrame:
    """(ins_code, chunk) -> array of (roll_seq, reference) for the market days current in that chunk."""
    end = F.coalesce(F.col("next_seq") - 1, F.col("last_seq"))
    step = F.lit(p.chunk_rows).cast("bigint")
    spans = rolls.select("day", "roll_seq", F.explode(F.sequence(
        chunk_of(F.col("roll_seq"), p.chunk_rows), chunk_of(end, p.chunk_rows), step)).alias("chunk"))
    present = cut.select("ins_code", "chunk").distinct()
    ref = F.when(F.col("ref_day").isNotNull(), F.struct("ref_day", "ref_volume", "ref_value", "ref_trades")).alias("ref")
    return (present.join(spans, "chunk").join(reference, ["ins_code", "day"], "left")
            .groupBy("ins_code", "chunk").agg(F.sort_array(F.collect_list(F.struct("roll_seq", ref))).alias("refs")))


def _flags(df: DataFrame) -> DataFrame:
    """Eligibility and carryover of each row; needs the session columns and ``refs``."""
    volume, value, trades = F.col("volume"), F.col("value"), F.col("trade_count")
    now = F.try_element_at(F.filter("refs", lambda r: r["roll_seq"] <= F.col("seq")), F.lit(-1))["ref"]
    before_open = F.coalesce(F.col("source_time") < F.col("open"), F.lit(False))
    active = rules.totals_active(volume, value, trades)
    ref = F.col("ref")
    repeats = (
        (ref["ref_day"] < F.col("day"))
        & rules.totals_active(ref["ref_volume"], ref["ref_value"], ref["ref_trades"])
        & rules.totals_same(volume, value, trades, ref["ref_volume"], ref["ref_value"], ref["ref_trades"]))
    return (df.withColumn("ref", now)
            .withColumns({"eligible": rules.flow_complete(), "active": active, "before_open": before_open})
            .withColumn("carry", F.when(~F.col("eligible"), None)
                        .when(F.col("before_open"), F.when(F.col("active"), "pre_open"))
                        .when(F.coalesce(repeats, F.lit(False)), "repeat"))
            .withColumn("ref_day", F.col("ref.ref_day")).drop("ref", "refs"))


def accept(snaps: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT, initial: DataFrame | None = None,
           held: DataFrame | None = None, begun: DataFrame | None = None) -> DataFrame:
    """Classify every snapshot and pair it with the accepted row before it.

    Adds day, session bounds, ``prev`` (struct of the last accepted row), the differences ``d_*`` and
    ``outcome``: incomplete, earlier_day, carryover, day_baseline, out_of_order, rebaseline or interval.

    To continue an earlier run, ``held`` brings each instrument's last accepted row, ``begun`` the day
    current then, and ``initial`` the totals seen (see ``prev_day_reference``).
    """
    rolls = stage(day_rolls(snaps, p, begun), "rolls")
    reference = prev_day_reference(snaps, p, rolls, initial)
    rows = snaps.select(*ENGINE_COLUMNS, F.lit(False).alias("held"))
    if held is not None:
        rows = rows.unionByName(held.select(*ENGINE_COLUMNS, F.lit(True).alias("held")))
    cut = rows.withColumns({"chunk": chunk_of(F.col("seq"), p.chunk_rows), "day": tehran.trading_day(F.col("source_time"))})
    refs = stage(_references_by_chunk(cut, rolls, reference, p), "refs")

    def flagged(info: DataFrame) -> DataFrame:
        return _flags(calendar.with_session(cut.join(info, ["ins_code", "chunk"], "left"), F.col("day")))

    usable = F.when((F.col("eligible") & F.col("carry").isNull()) | F.col("held"),
                    F.struct(F.col("source_time"), (-F.col("seq")).alias("before"), *PREV_COLUMNS))
    prefix = [Prefix("prev", usable, "max", inclusive=False)]
    totals = chunk_totals(flagged(refs), ["ins_code"], prefix)
    info = carried_in(totals, ["ins_code"], prefix).join(refs, ["ins_code", "chunk"], "left")
    out = within_chunk(flagged(info), ["ins_code"], prefix).drop("chunk")
    return outcomes(out.filter(~F.col("held")).drop("held"))


def outcomes(df: DataFrame) -> DataFrame:
    """Deltas and outcome of every row, given its predecessor ``prev`` and its carryover."""
    zero = F.lit(0).cast("bigint")
    prev_day = tehran.trading_day(F.col("prev.source_time"))
    # a total missing on a row reads as 0 in a difference
    deltas = {f"d_{t}": F.coalesce(F.col(t), zero) - F.coalesce(F.col(f"prev.{t}"), zero) for t in TOTALS}
    out = df.withColumn("prev_day", prev_day).withColumns(deltas)
    decrease = rules.any_of([F.col(f"d_{t}") < 0 for t in TOTALS])
    mismatch = (F.col("inst_buy_vol").isNotNull() & F.col("inst_sell_vol").isNotNull()
                & ((F.col("d_ind_buy_vol") + F.col("d_inst_buy_vol") != F.col("d_volume"))
                   | (F.col("d_ind_sell_vol") + F.col("d_inst_sell_vol") != F.col("d_volume"))))
    outcome = (F.when(~F.col("eligible"), "incomplete")
               .when(F.col("day") < F.col("prev_day"), "earlier_day")
               .when(F.col("carry").isNotNull(), "carryover")
               .when(F.col("prev").isNull() | (F.col("day") > F.col("prev_day")), "day_baseline")
               .when(F.col("source_time") <= F.col("prev.source_time"), "out_of_order")
               .when(decrease | mismatch, "rebaseline")
               .otherwise("interval"))
    late = (F.col("outcome") == "day_baseline") & ~(
        ~F.col("active") & (F.col("open").isNull() | F.col("before_open")))
    return (out.withColumn("decreased", decrease).withColumn("outcome", outcome).withColumn("late", late)
            .withColumn("window_start", tehran.window_start(F.col("open"), F.col("source_time"))))


def deltas(accepted: DataFrame) -> DataFrame:
    """The nine differences of every usable interval."""
    return accepted.filter(F.col("outcome") == "interval").select(
        "seq", "ins_code", "class", "day", F.col("prev.source_time").alias("interval_from"),
        F.col("source_time").alias("interval_to"), *[f"d_{t}" for t in TOTALS])
