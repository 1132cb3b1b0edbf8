"""Fills, forward returns, barrier labels and the statistics over them.

An order table has one row per signal: ins, no and day of the signal, cap, stop and level in raw rial of
that day. Prices between two days are compared through the adjustment factors ``g``; nothing is labelled
across a factor under review.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.eod import EOD, EodParams, percentile

BAR = ["pf", "pl", "pc", "py", "pmin", "pmax", "lock", "g", "seg"]


def fills(orders: DataFrame, bars: DataFrame, skip_if_open_below_level: bool = False) -> DataFrame:
    """Buy fill on the next session, base and conservative; NULL when unfilled.

    cap and stop are scaled by the session's adjustment factor and rounded down.
    """
    nxt = bars.select("ins", (F.col("no") - 1).alias("no"), F.col("no").alias("entry_no"), *[F.col(c).alias(f"e_{c}") for c in BAR])
    now = bars.select("ins", "no", F.col("g").alias("g0"), F.col("seg").alias("seg0"))
    out = orders.join(now, ["ins", "no"]).join(nxt, ["ins", "no"], "left")
    scale = F.when(F.col("seg0") == F.col("e_seg"), F.col("e_g") / F.col("g0"))
    # a rounding guard keeps whole rials whole where the factor is exactly 1
    out = out.withColumn("scale", scale).withColumns({
        "e_cap": F.floor(F.col("cap") * F.col("scale") + 1e-6), "e_stop": F.floor(F.col("stop") * F.col("scale") + 1e-6), "e_level": F.col("level") * F.col("scale")})
    cap, opened = F.col("e_cap"), F.col("e_pf")
    dead = F.col("scale").isNull() | F.coalesce(F.col("e_lock").isin("up", "flat"), F.lit(False))
    if skip_if_open_below_level:
        dead = dead | F.coalesce(opened < F.col("e_level"), F.lit(False))
    at_cap = F.when(F.col("e_pmin") <= cap, cap)
    base = F.when(opened <= cap, opened).otherwise(at_cap)
    careful = F.when(opened == F.col("e_pmax"), at_cap).otherwise(base)
    locked = F.coalesce(F.col("e_lock") == "down", F.lit(False))
    return out.withColumns({
        "fill_base": F.when(~dead, F.when(locked, F.col("e_pmin")).otherwise(base)).cast("bigint"),
        "fill_conservative": F.when(~dead, F.when(locked, F.col("e_pmin")).otherwise(careful)).cast("bigint")}).drop("g0", "seg0")


def sell_fills(bars: DataFrame) -> DataFrame:
    """For a sale ordered at each day's open: the first day it can be executed, and the price."""
    stuck = F.coalesce(F.col("lock").isin("down", "flat"), F.lit(False))
    price = F.when(F.col("lock") == "up", F.col("pmax")).otherwise(F.col("pf"))
    later = W.partitionBy("ins").orderBy("no").rowsBetween(0, W.unboundedFollowing)
    first = F.first(F.when(~stuck, F.struct(F.col("no").alias("no"), price.alias("price"))), ignorenulls=True).over(later)
    return bars.select("ins", "no", "day", first.alias("x")).select("ins", "no", "day", F.col("x.no").alias("sell_no"), F.col("x.price").alias("sell_price"))


def forward_returns(filled: DataFrame, bars: DataFrame, index: DataFrame, price: str = "fill_conservative", p: EodParams = EOD) -> DataFrame:
    """Net and excess return of every filled order after each horizon, anchored at the entry day."""
    entries = filled.filter(F.col(price).isNotNull()).select("trial", "ins", "no", "entry_no", F.col(price).alias("fill"), "e_g", "e_seg")
    horizons = F.explode(F.array(*[F.lit(h) for h in p.horizons])).alias("h")
    long = entries.select("*", horizons).withColumn("exit_no", F.col("entry_no") + F.col("h"))
    later = bars.select("ins", F.col("no").alias("exit_no"), F.col("pc").alias("x_pc"), F.col("g").alias("x_g"), F.col("seg").alias("x_seg"))
    out = long.join(later, ["ins", "exit_no"]).filter(F.col("e_seg") == F.col("x_seg"))
    gross = F.col("x_pc") / (F.col("fill") * F.col("x_g") / F.col("e_g")) - 1
    levels = index.select("no", "index")
    out = out.withColumn("net", gross - p.cost_pct / 100)
    out = out.join(levels.select(F.col("no").alias("exit_no"), F.col("index").alias("i_exit")), "exit_no", "left")
    out = out.join(levels.select((F.col("no") + 1).alias("entry_no"), F.col("index").alias("i_before")), "entry_no", "left")
    return out.withColumn("excess", F.col("net") - (F.col("i_exit") / F.col("i_before") - 1)).select(
        "trial", "ins", "no", "entry_no", "h", "fill", "net", "excess")


def triple_barrier(filled: DataFrame, bars: DataFrame, price: str = "fill_conservative", horizon: int = 10, p: EodParams = EOD) -> DataFrame:
    """First barrier touched within the horizon (the stop first when both are), with MFE, MAE and the net multiple of R.

    Each entry meets the bars of its next ``horizon`` days through an equi-join on (ins, day number).
    """
    entries = filled.filter(F.col(price).isNotNull() & (F.col(price) > F.col("e_stop"))).select(
        "trial", "ins", "no", "entry_no", F.col(price).alias("fill"), F.col("e_stop").alias("stop"), "e_g", "e_seg")
    days = entries.select("*", F.explode(F.sequence(F.col("entry_no") + 1, F.col("entry_no") + horizon)).alias("d"))
    later = bars.select("ins", F.col("no").alias("d"), "pc", "pmin", "pmax", F.col("g").alias("d_g"), F.col("seg").alias("d_seg"), F.col("lock").alias("d_lock"))
    on = days.join(later, ["ins", "d"]).filter(F.col("d_seg") == F.col("e_seg")).withColumn("s", F.col("d_g") / F.col("e_g"))
    r = F.col("fill") - F.col("stop")
    target, floor = (F.col("fill") + p.target_r * r) * F.col("s"), (F.col("fill") - p.stop_r * r) * F.col("s")
    stuck = F.coalesce(F.col("d_lock").isin("down", "flat"), F.lit(False))
    hit = F.when(F.col("pmin") <= floor, "stop").when(F.col("pmax") >= target, "target")
    # a stop touched on a day nothing can be sold is left at the first close that can
    on = on.withColumns({"hit": hit, "stuck": stuck, "close": F.col("pc") / F.col("s")})
    keys = ["trial", "ins", "no", "entry_no", "fill", "stop"]
    agg = on.groupBy(*keys).agg(
        F.min(F.when(F.col("hit").isNotNull(), F.struct("d", "hit", "stuck"))).alias("first"), F.max(F.struct("d", "close")).alias("last"),
        F.max(F.col("pmax") / F.col("s")).alias("top"), F.min(F.col("pmin") / F.col("s")).alias("bottom"),
        F.sort_array(F.collect_list(F.when(~F.col("stuck"), F.struct("d", "close")))).alias("open_days"))
    out_later = F.get(F.filter("open_days", lambda x: x["d"] > F.col("first.d")), F.lit(0))["close"]
    level = F.when(F.col("first.hit") == "target", F.col("fill") + p.target_r * (F.col("fill") - F.col("stop"))).otherwise(
        F.col("fill") - p.stop_r * (F.col("fill") - F.col("stop")))
    exit_price = (F.when(F.col("first").isNull(), F.col("last.close"))
                  .when((F.col("first.hit") == "stop") & F.col("first.stuck"), F.coalesce(out_later, F.col("last.close"))).otherwise(level))
    net = exit_price / F.col("fill") - 1 - p.cost_pct / 100
    return agg.withColumn("net", net).select(
        "trial", "ins", "no", "entry_no", F.coalesce("first.hit", F.lit("time")).alias("label"), F.coalesce("first.d", "last.d").alias("exit_no"), "net",
        (F.col("net") * F.col("fill") / (F.col("fill") - F.col("stop"))).alias("r_multiple"), (F.col("top") / F.col("fill") - 1).alias("mfe"),
        (F.col("bottom") / F.col("fill") - 1).alias("mae"))


def _log_gamma_ratio(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)) for a > 0: by its asymptotic series where a >= 16, reached by steps of one."""
    steps = F.when(a < 16, F.sequence(F.lit(0), F.ceil(16 - a).cast("int"))).otherwise(F.array().cast("array<int>"))
    shifted = F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.log1p(-0.5 / (a + k + 0.5)))
    z = a + F.size(steps)
    w = 1 / (z * z)
    series = 0.5 * F.ln(z) - (1 / 8 - w * (1 / 192 - w * (1 / 640 - w * (17 / 14336 - w * 31 / 18432)))) / z
    return shifted + series


def _beta_fraction(a: Column, b: float, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, for x < (a + 1) / (a + b + 2), by Lentz's rule."""
    steps = F.sequence(F.lit(1), F.ceil(60 + 8 * F.sqrt(a)).cast("int"))

    def near(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def turn(s: Column, num: Column) -> Column:
        d = 1 / near(1 + num * s["d"])
        c = near(1 + num / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.element_at(F.transform(F.array(turn(s, even)), lambda t: turn(t, odd)), 1)

    first = 1 / near(1 - (a + b) * x / (a + 1))
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f")), step)["f"]


def _tail(t: Column, n: Column) -> Column:
    """P(T > t) for t * t > 3: the tail itself, its leading factor in logarithms, so that nothing cancels."""
    a = n / 2
    x = n / (n + t * t)
    front = -a * F.log1p(t * t / n) + 0.5 * F.ln(1 - x) + _log_gamma_ratio(a) - 0.5 * math.log(math.pi)
    return F.exp(front) * _beta_fraction(a, 0.5, x) / a / 2


def one_sided_p(t: Column, dof: Column) -> Column:
    """P(T > t) of Student's t with a whole number of degrees of freedom.

    Near the middle 1 minus the body, a finite sum in cos^2 of atan(t / sqrt(dof)); beyond it the tail summed directly.
    """
    t, n = t.cast("double"), dof.cast("bigint")
    odd, cos2 = F.pmod(n, F.lit(2)), n / (n + t * t)
    last = F.floor((n - 2 - odd) / 2)
    ratio = lambda k: (2 * k - 1 + odd) / (2 * k + odd) * cos2
    steps = F.when(last >= 1, F.sequence(F.lit(1).cast("bigint"), last)).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1.0)
    total = F.aggregate(steps, F.struct(one.alias("term"), one.alias("sum")), lambda s, k: F.struct(
        (s["term"] * ratio(k)).alias("term"), (s["sum"] + s["term"] * ratio(k)).alias("sum")))["sum"]
    sin = t / F.sqrt(n + t * t)
    inside = F.when(odd == 0, sin * total).otherwise(
        (F.atan(t / F.sqrt(n.cast("double"))) + F.when(n > 1, sin * F.sqrt(cos2) * total).otherwise(0.0)) * (2 / math.pi))
    real = n.cast("double")
    return F.when((n > 0) & (t > 2), _tail(t, real)).when((n > 0) & (t < -2), 1 - _tail(-t, real)).when(n > 0, (1 - inside) / 2)


def newey_west(returns: DataFrame, p: EodParams = EOD) -> DataFrame:
    """t statistic of the mean daily excess return per trial and horizon, Bartlett weights up to lag h - 1."""
    daily = returns.filter(F.col("excess").isNotNull()).groupBy("trial", "h", "no").agg(F.avg("excess").alias("x"), F.count(F.lit(1)).alias("n"))
    series = W.partitionBy("trial", "h")
    ordered = series.orderBy("no")
    dev = daily.withColumn("e", F.col("x") - F.avg("x").over(series))
    lags = max(p.horizons)
    cov = F.lit(0.0)
    for j in range(lags):
        weight = F.when(F.col("h") > j, 1.0 if j == 0 else 2 * (1 - F.lit(j) / F.col("h"))).otherwise(0.0)
        cov = cov + weight * F.col("e") * F.coalesce(F.lag("e", j).over(ordered) if j else F.col("e"), F.lit(0.0))
    out = dev.withColumn("s", cov).groupBy("trial", "h").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("events"), F.avg("x").alias("mean"), (F.sum("s") / F.count(F.lit(1))).alias("var"))
    out = out.withColumn("se", F.when(F.col("var") > 0, F.sqrt(F.col("var") / F.col("days"))))
    return out.withColumn("t", F.col("mean") / F.col("se")).drop("var")


def benjamini_hochberg(tests: DataFrame, p: EodParams = EOD) -> DataFrame:
    """FDR over all trials; a trial with too few events is never significant but still counts."""
    with_p = tests.withColumn("p", one_sided_p(F.col("t"), F.col("days") - 1))
    with_p = with_p.withColumn("enough", F.col("events") >= p.min_events).withColumn("_p", F.when(F.col("enough"), F.coalesce("p", F.lit(1.0))).otherwise(1.0))
    everything = W.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy("_p", "trial", "h"))
    out = with_p.withColumn("_ratio", F.col("_p") * F.count(F.lit(1)).over(everything) / rank).withColumn("_rank", rank)
    adjusted = F.least(F.min("_ratio").over(everything.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0))
    return out.withColumn("p_adjusted", adjusted).withColumn("passes", F.col("enough") & (F.col("p_adjusted") <= p.fdr_q)).drop("_p", "_ratio", "_rank")


def basis_gate(by_volume: DataFrame, by_value: DataFrame, p: EodParams = EOD) -> DataFrame:
    """Agreement of the two flow bases: daily Spearman of F1 and F2 (mean, 5th percentile) and the family flip rate."""
    def ranked(df: DataFrame, side: str) -> DataFrame:
        out = df.select("ins", "no", *[percentile(c, ["no"], F.col("in_universe"), p.min_cross_section).alias(f"{c}_{side}") for c in ("f1", "f2", "f3_count")])
        family = (F.col(f"f1_{side}") + F.col(f"f2_{side}") + F.col(f"f3_count_{side}")) / 3
        return out.withColumn(f"family_{side}", family)

    both = ranked(by_volume, "a").join(ranked(by_value, "b"), ["ins", "no"])
    # correlation of average ranks is Spearman's coefficient; percentiles are ranks on another scale
    sides = F.col("family_a").isNotNull() & F.col("family_b").isNotNull()
    flipped = sides & ((F.col("family_a") >= p.family_min_pct) != (F.col("family_b") >= p.family_min_pct))
    def rho(c: str) -> Column:
        """Correlation over the pairs present; NULL without any spread."""
        pair = F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull()
        a, b = F.when(pair, F.col(f"{c}_a")), F.when(pair, F.col(f"{c}_b"))
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    daily = both.groupBy("no").agg(rho("f1").alias("f1"), rho("f2").alias("f2"),
                                   F.count(F.when(sides, 1)).alias("placed"), F.count(F.when(flipped, 1)).alias("flips"))
    return daily.agg(*[x for c in ("f1", "f2") for x in (F.avg(c).alias(f"{c}_mean"), F.expr(f"percentile({c}, 0.05)").alias(f"{c}_p5"))],
                     (F.sum("flips") * 100 / F.sum("placed")).alias("flip_pct"))


def scoreboard(closed: DataFrame, backtest: DataFrame, p: EodParams = EOD, chunk_days: int = 60) -> DataFrame:
    """Rolling window of the last closed signals per trial, their z against the backtest, and the status.

    A trial is cut into chunks of ``chunk_days`` closing days. Each chunk hands on its last signals; as no chunk is empty, as many chunks
    as the window has rows before the current one are enough to fill the window of a chunk's first row. No task holds a whole trial.
    """
    before = p.scoreboard - 1
    order = ["exit_no", "ins", "no"]
    rows = closed.select("trial", *order, "r_multiple", F.floor(F.col("exit_no") / chunk_days).alias("chunk"))
    latest = W.partitionBy("trial", "chunk").orderBy(*[F.desc(c) for c in order])
    tails = (rows.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= before)
             .groupBy("trial", "chunk").agg(F.sort_array(F.collect_list(F.struct(*order, "r_multiple"))).alias("tail")))
    earlier = W.partitionBy("trial").orderBy("chunk").rowsBetween(-before, -1)
    handed = tails.select("trial", "chunk", F.flatten(F.collect_list("tail").over(earlier)).alias("tail"))
    handed = handed.select("trial", "chunk", F.inline(F.expr(f"slice(tail, greatest(1, size(tail) - {before - 1}), {before})")))
    both = rows.withColumn("own", F.lit(True)).unionByName(handed.withColumn("own", F.lit(False)))
    w = W.partitionBy("trial", "chunk").orderBy(*order).rowsBetween(-before, 0)
    live = both.withColumns({"n": F.count("r_multiple").over(w), "live_mean": F.avg("r_multiple").over(w)}).filter("own")
    out = live.join(backtest.select("trial", F.col("mean").alias("bt_mean"), F.col("sd").alias("bt_sd")), "trial")
    z = (F.col("live_mean") - F.col("bt_mean")) / (F.col("bt_sd") / F.sqrt("n"))
    out = out.withColumn("z", z)
    status = F.when(F.col("n") < p.scoreboard, "evaluating").when((F.col("live_mean") < 0) | (F.col("z") < -2.0), "suspended").otherwise("active")
    return out.withColumn("status", status).select("trial", "ins", "no", "exit_no", "n", "live_mean", "z", "status")
