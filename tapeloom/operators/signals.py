"""Radar signals: deviations from an instrument's own exponentially weighted history, and flow-price divergence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions import rules, tehran
from tapeloom.operators.calendar import DEFAULT_CALENDAR, UNKNOWN, Calendar
from tapeloom.operators.ordered import Prefix, running
from tapeloom.params import DEFAULT, Params

FEATURES = ["value_rate", "net_ind_rate"]


def observation(value: Column, net: Column, start: Column, end: Column, p: Params = DEFAULT) -> Column:
    """An interval's per-second features and whether it is scored; NULL if it does not train. Needs open, class and ``opens``."""
    secs = tehran.seconds_between(start, end)
    rate = value / F.when(secs > 0, secs)
    at, skip = F.unix_micros(end), p.opening_skip * 1_000_000

    def opening(o: Column) -> Column:
        return (at >= F.unix_micros(o)) & (at < F.unix_micros(o) + skip)

    scored = (at >= F.unix_micros("open") + skip) & ~((F.col("class") == UNKNOWN) & F.exists("opens", opening))
    features = F.struct(rate.alias("value_rate"), (net / F.when(secs > 0, secs)).alias("net_ind_rate"), scored.alias("scored"))
    return F.when(F.col("open").isNotNull() & (rate >= p.min_value_rate), features)


def observations(intervals: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT) -> DataFrame:
    """Intervals that train the radar, with their per-second features and whether they are scored.

    Closed days neither score nor train; the first minutes after the open train only. An instrument of
    unknown class could belong to any class, so it skips the minutes after every class open.
    """
    rows = calendar.opens(intervals.filter(F.col("open").isNotNull()))
    seen = observation(F.col("value"), F.col("net_ind_value"), F.col("interval_from"), F.col("interval_to"), p)
    rows = rows.withColumn("_seen", seen).filter(F.col("_seen").isNotNull())
    return rows.select("*", "_seen.*").drop("_seen", "opens", "open")


def _block_length(alpha: float) -> int:
    """Observations after which an old value's weight is below 1e-20; so no weight inside a block exceeds 1e20."""
    return math.ceil(math.log(1e-20) / math.log1p(-alpha))


def ewma_state(obs: DataFrame, p: Params = DEFAULT, block: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Add ``n``, ``<feature>_mean`` and ``<feature>_var``: the baseline before each observation.

    An exponentially weighted mean and second moment are weighted sums, so no row-by-row fold is needed.
    History is cut into blocks long enough for the weights of a block to fade below double precision;
    inside a block the sums are window sums with growing weights (at most 1e20), and the block before
    it (with a trace of the one before that) gives the starting state. Values are centred on the block
    average, so that the variance does not suffer from cancellation.

    ``initial`` (see ``ewma_after``) is the baseline an earlier run ended with.
    """
    a = p.alpha
    keep = 1.0 - a
    block = block or _block_length(a)
    one = F.lit(1).cast("bigint")
    rows = running(obs, ["ins_code"], [Prefix("k", one, "sum", inclusive=False)], p.chunk_rows)
    rows = rows.withColumn("k", F.coalesce("k", F.lit(0)).cast("bigint"))
    size = F.lit(block).cast("bigint")
    rows = rows.withColumn("i", F.pmod("k", size)).withColumn("block", F.expr(f"k div {block}"))
    if initial is None:
        rows = rows.withColumn("n", F.col("k"))
    else:
        seen = initial.select("ins_code", F.col("n").alias("n0"))
        rows = rows.join(seen, "ins_code", "left").withColumn("n", F.col("k") + F.coalesce("n0", F.lit(0))).drop("n0")
    whole = W.partitionBy("ins_code", "block")
    before = whole.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"{f}_c": F.avg(f).over(whole) for f in FEATURES})
    # weight of observation i seen from observation j > i is grow(i) * keep^(j-1); the very first has weight 1
    grow = F.pow(F.lit(keep), -F.col("i").cast("double")) * F.when(F.col("n") == 0, 1.0).otherwise(a)

    def sums(f: str) -> dict[str, Column]:
        x = F.col(f) - F.col(f"{f}_c")
        return {f"{f}_1": grow * x, f"{f}_2": grow * x * x}

    weighted = rows.withColumns({k: v for f in FEATURES for k, v in sums(f).items()} | {"w": grow})
    names = [f"{f}_{k}" for f in FEATURES for k in (1, 2)]
    # state each block leaves behind, as (weight, mean, variance) of its own observations
    ends = weighted.groupBy("ins_code", "block").agg(
        F.count(F.lit(1)).alias("len"), F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in names],
        *[F.first(f"{f}_c").alias(f"{f}_c") for f in FEATURES])

    def own(f: str) -> list[Column]:
        m = F.col(f"{f}_1") / F.col("w")
        return [(m + F.col(f"{f}_c")).alias(f"{f}_m"), F.greatest(F.col(f"{f}_2") / F.col("w") - m * m, F.lit(0.0)).alias(f"{f}_v")]

    ends = ends.select("ins_code", "block", *[c for f in FEATURES for c in own(f)])
    if initial is not None:
        held = [F.col(f"{f}_{k}").alias(f"{f}_{k[0]}") for f in FEATURES for k in ("mean", "var")]
        ends = ends.unionByName(initial.select("ins_code", F.lit(-1).cast("bigint").alias("block"), *held))
    by_block = W.partitionBy("ins_code").orderBy("block")
    faded = keep ** block
    trace = {}
    for f in FEATURES:
        m1, m2 = F.lag(f"{f}_m").over(by_block), F.lag(f"{f}_m", 2).over(by_block)
        v1, v2 = F.lag(f"{f}_v").over(by_block), F.lag(f"{f}_v", 2).over(by_block)
        old = F.when(m2.isNull(), 0.0).otherwise(faded)
        trace[f"{f}_m0"] = (1 - old) * m1 + F.coalesce(old * m2, F.lit(0.0))
        trace[f"{f}_v0"] = ((1 - old) * v1 + F.coalesce(old * v2, F.lit(0.0))
                            + F.coalesce(old * (1 - old) * (m1 - m2) * (m1 - m2), F.lit(0.0)))
    starts = ends.select("ins_code", "block", *[c.alias(k) for k, c in trace.items()])
    out = weighted.join(starts, ["ins_code", "block"], "left")
    fade = F.pow(F.lit(keep), (F.col("i") - 1).cast("double"))
    start_w = F.when(F.col(f"{FEATURES[0]}_m0").isNotNull(), F.pow(F.lit(keep), F.col("i").cast("double"))).otherwise(0.0)
    cols = {}
    for f in FEATURES:
        c, m0, v0 = F.col(f"{f}_c"), F.col(f"{f}_m0"), F.col(f"{f}_v0")
        s1 = F.coalesce(F.sum(f"{f}_1").over(before), F.lit(0.0)) * fade
        s2 = F.coalesce(F.sum(f"{f}_2").over(before), F.lit(0.0)) * fade
        e1 = s1 + F.when(start_w > 0, start_w * (m0 - c)).otherwise(0.0)
        e2 = s2 + F.when(start_w > 0, start_w * (v0 + (m0 - c) * (m0 - c))).otherwise(0.0)
        cols[f"{f}_mean"] = F.when(F.col("n") > 0, e1 + c)
        # the very first observation sets the mean: one observation has no spread
        cols[f"{f}_var"] = F.when(F.col("n") > 1, F.greatest(e2 - e1 * e1, F.lit(0.0))).when(F.col("n") == 1, 0.0)
    out = out.withColumns(cols)
    return out.select(*obs.columns, "n", *cols)


def ewma_after(state: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(ins_code, n, <feature>_mean, <feature>_var) after each instrument's last observation."""
    last = F.max(F.struct("seq", "n", *FEATURES, *[f"{f}_{k}" for f in FEATURES for k in ("mean", "var")])).alias("l")
    rows = state.groupBy("ins_code").agg(last).select("ins_code", "l.*")
    cols = {}
    for f in FEATURES:
        x, m, v = F.col(f), F.col(f"{f}_mean"), F.col(f"{f}_var")
        d = x - m
        cols[f"{f}_mean"] = F.when(F.col("n") == 0, x).otherwise(m + p.alpha * d)
        cols[f"{f}_var"] = F.when(F.col("n") == 0, 0.0).otherwise((1 - p.alpha) * (v + p.alpha * d * d))
    return rows.select("ins_code", (F.col("n") + 1).alias("n"), *[c.alias(k) for k, c in cols.items()])


def anomalies(intervals: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT, block: int | None = None) -> DataFrame:
    """Intervals far from the instrument's own baseline, one row per feature."""
    return anomalies_of(ewma_state(observations(intervals, calendar, p), p, block), p)


def anomalies_of(state: DataFrame, p: Params = DEFAULT) -> DataFrame:
    per_feature = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"{f}_mean").alias("mean"),
                                     F.col(f"{f}_var").alias("var")) for f in FEATURES])
    ready = state.filter(F.col("scored") & (F.col("n") >= p.warm_up)).select(
        "seq", "ins_code", "class", "day", F.col("interval_to").alias("at"), F.inline(per_feature))
    z = (F.col("value") - F.col("mean")) / F.sqrt("var")
    hits = ready.filter(F.col("var") > 0).withColumn("z", z).filter(F.abs("z") >= p.z_threshold)
    return hits.select("seq", "ins_code", "class", "day", F.lit("anomaly").alias("kind"), "feature", F.round("z", 2).alias("z"), "value",
                       "mean", "at", rules.anomaly_reason(F.col("feature"), F.col("z")).alias("reason"))


def divergence(windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Large net flow against a flat or opposite price: the first complete state of a window that meets it."""
    chg = rules.window_change_pct(F.col("price_open"), F.col("price_last"))
    kind = (F.when((F.col("net_hot") >= p.divergence_hot) & (chg <= p.divergence_flat), "absorption")
            .when((F.col("net_hot") <= -p.divergence_hot) & (chg >= -p.divergence_flat), "support"))
    hits = windows.filter(~F.col("partial") & (F.col("price_open") > 0)).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return divergence_once(hits)


def divergence_once(hits: DataFrame) -> DataFrame:
    first = F.min(F.struct("seq", "kind", "net_hot", "class", "day")).alias("f")
    return hits.groupBy("ins_code", "window_start").agg(first).select(
        "f.seq", "ins_code", "f.class", "f.day", "f.kind", F.col("f.net_hot").cast("double").alias("value"),
        F.col("window_start").alias("at"), rules.lookup(F.col("f.kind"), rules.DIVERGENCE_REASONS).alias("reason"))


def signals(intervals: DataFrame, windows: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT) -> DataFrame:
    """Both signal kinds in one table."""
    return anomalies(intervals, calendar, p).unionByName(divergence(windows, p), allowMissingColumns=True)
