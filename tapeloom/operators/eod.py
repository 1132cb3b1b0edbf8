"""End-of-day features over daily bars: adjustment, liquidity, flow, reaction, trend, universe, regime and setups.

A bar table has one row per instrument and traded day, so an instrument's group is bounded by the number
of trading days and a day's group by the number of instruments. Windows counted in trading days use range
frames over the day number, windows over an instrument's own history use row frames inside a segment
between price adjustments under review.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EodParams:
    """Published thresholds of the signal tables (percentages as numbers)."""

    review_min: float = 0.05
    review_max: float = 1.0
    reconcile_pct: float = 0.5
    mdv_days: int = 20
    flow_days: int = 5
    flow_min_days: int = 4
    strong_power: float = 1.2
    rvol_days: int = 20
    rvol_min_days: int = 15
    ad_days: int = 65
    ad_min_days: int = 50
    er_days: int = 5
    quiet_rvol: float = 3.0
    quiet_ret_pct: float = 1.0
    absorption_flow_pct: float = 70.0
    absorption_er_pct: float = 0.0
    thin_flow_pct: tuple[float, float] = (40.0, 70.0)
    thin_er_pct: float = 70.0
    no_flow_er_pct: float = 80.0
    rs_weights: dict[int, float] = field(default_factory=lambda: {20: 0.5, 60: 0.3, 120: 0.2})
    fast_ma: int = 20
    slow_ma: int = 50
    slope_days: int = 10
    atr_short: int = 10
    atr_long: int = 50
    atr_risk: int = 14
    vol_short: int = 10
    vol_long: int = 50
    high_days: tuple[int, int] = (60, 240)
    lock_days: int = 60
    lookback_days: int = 60
    min_trading_days: int = 45
    min_value_pct: float = 40.0
    halt_days: int = 10
    cooldown_days: int = 3
    min_cross_section: int = 80
    family_min_pct: float = 60.0
    breadth_up: float = 55.0
    breadth_down: float = 40.0
    flow_windows: tuple[int, int] = (5, 20)
    risk_on: float = 0.6
    risk_off: float = -0.6
    confirm_days: int = 2
    g1_ad_pct: float = 70.0
    g1_persistence: int = 3
    g1_atr_ratio: float = 0.75
    g1_vol_dryup: float = 0.9
    g1_ret_pct: float = 8.0
    g1_level_days: int = 20
    g1_rvol: float = 1.5
    g1_cap_atr: float = 0.5
    stop_days: int = 5
    max_stop_atr: float = 2.5
    m3_sellers: float = 1.2
    m3_days: int = 5
    m3_power: float = 1.5
    m3_weak_days: int = 2
    near_miss_pct: float = 50.0
    cost_pct: float = 0.3712 + 0.8812 + 2 * 0.10
    horizons: tuple[int, ...] = (3, 5, 10)
    target_r: float = 2.0
    stop_r: float = 1.0
    fdr_q: float = 0.10
    min_events: int = 30
    scoreboard: int = 30


EOD = EodParams()


def _i() -> W:
    return W.partitionBy("ins").orderBy("no")


def _s() -> W:
    return W.partitionBy("ins", "seg").orderBy("no")


def _median(value: str, window: W) -> Column:
    """Median over a short frame (at most a few dozen rows)."""
    rows = F.array_sort(F.collect_list(value).over(window))
    n = F.size(rows)
    low, high = F.get(rows, F.floor((n - 1) / 2).cast("int")), F.get(rows, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def _when_warm(n: int, value: Column) -> Column:
    """Value once the segment has ``n`` rows."""
    return F.when(F.col("idx") >= n - 1, value)


def numbered(bars: DataFrame) -> DataFrame:
    """Add ``no``: the position of the day among the market's trading days."""
    days = bars.select("day").distinct().withColumn("no", F.row_number().over(W.orderBy("day")).cast("bigint"))
    return bars.join(days, "day")


def lock_day(pmin: Column, pmax: Column, pc: Column, py: Column) -> Column:
    """All trades at one price: up, down or flat by the close against yesterday; NULL when not locked."""
    return F.when(pmin == pmax, F.when(pc > py, "up").when(pc < py, "down").otherwise("flat"))


def adjust_prices(bars: DataFrame, p: EodParams = EOD) -> DataFrame:
    """Adjustment factors and segments.

    ``f`` is py(t) / pc(t-1) on the days they differ. A factor outside the review range is not applied; it
    starts a new segment, across which nothing is computed. ``g`` is the product of the factors so far, so
    a price seen from day t is price(s) * g(t) / g(s); ``adj_*`` are prices over g, whose ratios do not
    depend on the anchor.
    """
    before = F.lag("pc").over(_i())
    raw = F.when(before.isNotNull() & (F.col("py") != before), F.col("py") / before)
    out = bars.withColumn("factor", raw)
    review = F.col("factor").isNotNull() & ((F.col("factor") < p.review_min) | (F.col("factor") > p.review_max))
    out = out.withColumn("review", review).withColumn("f", F.when(~F.col("review"), F.col("factor")).otherwise(1.0))
    out = out.withColumn("f", F.coalesce("f", F.lit(1.0)))
    running = _i().rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({"seg": F.sum(F.col("review").cast("int")).over(running), "g": F.exp(F.sum(F.ln("f")).over(running))})
    out = out.withColumn("idx", F.row_number().over(_s()) - 1)
    return out.withColumns({f"adj_{n}": F.col(c) / F.col("g") for n, c in
                            {"close": "pc", "last": "pl", "high": "pmax", "low": "pmin", "open": "pf"}.items()} | {"adj_volume": F.col("tvol") * F.col("g")})


def reconcile_sources(a: DataFrame, b: DataFrame, p: EodParams = EOD) -> DataFrame:
    """Symbol-days whose close or volume differ by more than the tolerance between two sources."""
    both = a.select("ins", "day", "pc", "tvol").join(b.select("ins", "day", F.col("pc").alias("pc_b"), F.col("tvol").alias("tvol_b")), ["ins", "day"])

    def off(x: str, y: str) -> Column:
        return F.abs(F.col(x) - F.col(y)) / F.col(x) * 100 > p.reconcile_pct

    return both.withColumns({"close_differs": off("pc", "pc_b"), "volume_differs": off("tvol", "tvol_b")}).filter("close_differs or volume_differs")


def wilder(df: DataFrame, value: str, name: str, n: int, alpha: float | None = None) -> DataFrame:
    """Exponential smoothing inside a segment, started with the mean of the first ``n`` values (Wilder: alpha = 1/n).

    The smoothed value is a weighted sum. Rows are cut into blocks after which old weights are below 1e-90;
    inside a block a window sum with growing weights gives it, on top of what the block before ended with.
    """
    a = alpha or 1.0 / n
    keep = 1.0 - a
    block = max(n, math.floor(90 * math.log(10) / -math.log(keep)))
    s = W.partitionBy("ins", "seg").orderBy("no")
    first = F.avg(value).over(s.rowsBetween(-(n - 1), 0))
    x = F.when(F.col("idx") == n - 1, first).when(F.col("idx") >= n, F.lit(a) * F.col(value))
    out = df.withColumn("_b", F.floor(F.col("idx") / block)).withColumn("_i", F.col("idx") - F.col("_b") * block).withColumn("_x", x)
    in_block = W.partitionBy("ins", "seg", "_b").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    own = F.sum(F.col("_x") * F.pow(F.lit(keep), -F.col("_i").cast("double"))).over(in_block) * F.pow(F.lit(keep), F.col("_i").cast("double"))
    out = out.withColumn("_own", own)
    # the block before ended with its own sum (older blocks have faded away)
    ended = F.last(F.when(F.col("_i") == block - 1, F.col("_own")), ignorenulls=True).over(s.rowsBetween(W.unboundedPreceding, -1))
    carried = F.when(F.col("_b") > 0, F.coalesce(ended, F.lit(0.0)) * F.pow(F.lit(keep), (F.col("_i") + 1).cast("double"))).otherwise(0.0)
    return out.withColumn(name, _when_warm(n, F.col("_own") + carried)).drop("_b", "_i", "_x", "_own")


def price_features(adjusted: DataFrame, p: EodParams = EOD) -> DataFrame:
    """Moving averages, rates of change, ATR, liquidity and locks."""
    s, i = _s(), _i()
    prev = F.lag("adj_close").over(s)
    tr = F.greatest(F.col("adj_high") - F.col("adj_low"), F.abs(F.col("adj_high") - prev), F.abs(F.col("adj_low") - prev))
    out = adjusted.withColumns({
        "lock": lock_day(F.col("pmin"), F.col("pmax"), F.col("pc"), F.col("py")), "tr": tr,
        "mdv20": F.when(F.col("no") - F.min("no").over(W.partitionBy("ins")) >= p.mdv_days, _median("tval", i.rangeBetween(-p.mdv_days, -1))),
        **{f"ma{n}": _when_warm(n, F.avg("adj_close").over(s.rowsBetween(1 - n, 0))) for n in (p.fast_ma, p.slow_ma)},
        **{f"roc{n}": F.col("adj_close") / F.lag("adj_close", n).over(s) - 1 for n in (1, p.er_days, *p.rs_weights)},
    })
    for n in (p.atr_short, p.atr_risk, p.atr_long):
        out = wilder(out, "tr", f"atr{n}", n)
    down = F.count(F.when(F.col("lock") == "down", 1)).over(i.rangeBetween(1 - p.lock_days, 0))
    return out.withColumns({"atr_pct": F.col(f"atr{p.atr_risk}") / F.col("adj_close"), "down_lock_days": down})


def flow_features(bars: DataFrame, p: EodParams = EOD, basis: str = "volume") -> DataFrame:
    """F1 net real flow over MDV20, F2 buyer power, F3 persistence (count and run), F5 ownership shift."""
    window = _i().rangeBetween(1 - p.flow_days, 0)
    if basis == "volume":
        nrf = F.when(F.col("tvol") > 0, (F.col("buy_i_vol") - F.col("sell_i_vol")) * (F.col("tval") / F.col("tvol")))
        buy, sell = F.col("buy_i_vol"), F.col("sell_i_vol")
    else:
        nrf, buy, sell = (F.col("buy_i_value") - F.col("sell_i_value")).cast("double"), F.col("buy_i_value"), F.col("sell_i_value")
    usable = (buy > 0) & (sell > 0) & (F.col("buy_i_count") > 0) & (F.col("sell_i_count") > 0)
    power = F.when(usable, (buy / F.col("buy_i_count")) / (sell / F.col("sell_i_count")))
    out = bars.withColumns({"nrf_day": nrf, "buyer_power": power})
    strong = F.coalesce((F.col("nrf_day") > 0) & (F.col("buyer_power") > p.strong_power), F.lit(False))
    out = out.withColumn("strong", strong)
    out = out.withColumns({"valid_days": F.count("nrf_day").over(window), "f3_count": F.count(F.when(F.col("strong"), 1)).over(window)})
    ordered = _i()
    # a run ends at a weak day and at a day without a row
    goes_on = F.coalesce(F.lag("strong").over(ordered) & (F.lag("no").over(ordered) == F.col("no") - 1), F.lit(False))
    out = out.withColumn("_start", F.when(F.col("strong") & ~goes_on, F.col("no")))
    start = F.last("_start", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumns({
        "f1": F.when((F.col("valid_days") >= p.flow_min_days) & (F.col("mdv20") > 0), F.sum("nrf_day").over(window) / F.col("mdv20")),
        "f2": F.col("buyer_power"),
        "f3_run": F.when(F.col("strong"), F.least(F.col("no") - start + 1, F.lit(p.flow_days).cast("bigint"))).otherwise(F.lit(0).cast("bigint")),
        "f5": F.when(F.col("tvol") > 0, (F.col("buy_i_vol") - F.col("sell_i_vol")) / F.col("tvol")),
    }).drop("_start")


def reaction_features(bars: DataFrame, p: EodParams = EOD) -> DataFrame:
    """P1 relative volume, P2 close location, P4 accumulation rating, P6 quiet volume."""
    i = _i()
    base = i.rangeBetween(-p.rvol_days, -1)
    span = F.col("pmax") - F.col("pmin")
    clv = F.when(span > 0, ((F.col("pl") - F.col("pmin")) - (F.col("pmax") - F.col("pl"))) / span)
    out = bars.withColumns({
        "rvol": F.when(F.count("tvol").over(base) >= p.rvol_min_days, F.col("tvol") / _median("tvol", base)), "clv": clv})
    rated = i.rangeBetween(1 - p.ad_days, 0)
    used = F.when(F.col("clv").isNotNull(), F.col("tvol"))
    ad = F.sum(F.col("clv") * F.col("tvol")).over(rated) / F.sum(used).over(rated)
    quiet = (F.col("rvol") >= p.quiet_rvol) & ((F.abs("roc1") * 100 <= p.quiet_ret_pct) | F.col("lock").isNotNull())
    return out.withColumns({"ad": F.when(F.count("clv").over(rated) >= p.ad_min_days, ad), "quiet": F.coalesce(quiet, F.lit(False))})


def trend_features(bars: DataFrame, p: EodParams = EOD) -> DataFrame:
    """T1 weighted rate of change, T2 gate, T3 contraction parts, T4 distance to the highs."""
    s = _s()
    rs = sum((F.lit(w) * F.col(f"roc{n}") for n, w in p.rs_weights.items()), F.lit(0.0))
    slow, fast = F.col(f"ma{p.slow_ma}"), F.col(f"ma{p.fast_ma}")
    # an unchanged average is not falling, whatever its last bits say
    gate = (F.col("adj_close") > fast) & (fast > slow) & (slow - F.lag(f"ma{p.slow_ma}", p.slope_days).over(s) >= -1e-9 * slow)
    short = F.avg("adj_volume").over(s.rowsBetween(1 - p.vol_short, 0))
    long = F.avg("adj_volume").over(s.rowsBetween(1 - p.vol_long, 0))
    return bars.withColumns({
        "rs": rs, "gate": gate, "atr_ratio": F.col(f"atr{p.atr_short}") / F.when(F.col(f"atr{p.atr_long}") > 0, F.col(f"atr{p.atr_long}")),
        "vol_dryup": _when_warm(p.vol_long, short / long),
        **{f"dist{n}": _when_warm(n, F.col("adj_close") / F.max("adj_high").over(s.rowsBetween(1 - n, 0)) - 1) for n in p.high_days}})


def percentile(value: str, keys: list[str], among: Column | None = None, min_n: int = 2) -> Column:
    """100 * (average rank - 1) / (N - 1) among rows with a value; NULL below ``min_n`` rows."""
    ok = F.col(value).isNotNull() if among is None else (F.col(value).isNotNull() & among)
    day = W.partitionBy(*keys, ok)
    rank = F.rank().over(day.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, ok, value)) - 1) / 2
    n = F.count(F.lit(1)).over(day)
    return F.when(ok & (n >= max(min_n, 2)), 100 * (rank - 1) / (n - 1))


def universe(bars: DataFrame, p: EodParams = EOD) -> DataFrame:
    """U1 enough traded days, U2 liquidity percentile, U4 cooldown after a halt, U6 no adjustment under review."""
    i = _i()
    gap = F.col("no") - F.lag("no").over(i) - 1
    out = bars.withColumns({
        "u1": F.count(F.lit(1)).over(i.rangeBetween(1 - p.lookback_days, 0)) >= p.min_trading_days,
        "_reopened": F.when(gap >= p.halt_days, F.col("no")), "u6": ~F.col("review")})
    out = out.withColumn("value_pct", percentile("mdv20", ["day"]))
    since = F.col("no") - F.last("_reopened", ignorenulls=True).over(i.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumns({"u2": F.coalesce(F.col("value_pct") >= p.min_value_pct, F.lit(False)), "u4": F.coalesce(since >= p.cooldown_days, F.lit(True))})
    return out.withColumn("in_universe", F.col("u1") & F.col("u2") & F.col("u6")).drop("_reopened")


def scored_features(p: EodParams = EOD) -> list[str]:
    return ["f1", "f2", "f3_count", "rvol", "clv", "ad", "rs", "atr_ratio", "vol_dryup", *[f"dist{n}" for n in p.high_days]]


def percentiles(rows: DataFrame, columns: list[str], keys: list[str], among: Column, min_n: int, row: list[str]) -> DataFrame:
    """``row`` and ``<column>_pct`` of every row of ``among`` that has one: ``percentile`` of many columns at once.

    All columns become rows of one long table, ranked by one window over (keys, column); one aggregation brings the percentiles of a
    row together again. Two shuffles, however many columns there are.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = rows.filter(among).select(*row, *[k for k in keys if k not in row], F.inline(cells)).filter(F.col("value").isNotNull())
    section = W.partitionBy(*keys, "column")
    ordered = section.orderBy("value")
    # Equal values share the mean of their ranks: rows below, and half of the other rows with the same value.
    below, same = F.rank().over(ordered) - 1, F.count(F.lit(1)).over(ordered.rangeBetween(W.currentRow, W.currentRow))
    n = F.count(F.lit(1)).over(section)
    ranked = long.select(*row, "column", F.when(n >= max(min_n, 2), 100 * (below + (same - 1) / 2) / (n - 1)).alias("pct"))
    return ranked.groupBy(*row).agg(*[F.max(F.when(F.col("column") == c, F.col("pct"))).alias(f"{c}_pct") for c in columns])


def normalized(features: DataFrame, p: EodParams = EOD) -> DataFrame:
    """Cross-sectional percentiles of every scored feature inside the universe. Reads ``features`` twice."""
    found = percentiles(features, scored_features(p), ["day"], F.col("in_universe"), p.min_cross_section, ["ins", "day"])
    return features.join(found, ["ins", "day"], "left")


def families(norm: DataFrame, p: EodParams = EOD) -> DataFrame:
    """Family scores (NULL if a member is), eligibility and the geometric-mean rank."""
    contraction = ((100 - F.col("atr_ratio_pct")) + (100 - F.col("vol_dryup_pct"))) / 2
    near, far = p.high_days
    distance = (F.col(f"dist{near}_pct") + F.col(f"dist{far}_pct")) / 2
    out = norm.withColumns({
        "flow_family": (F.col("f1_pct") + F.col("f2_pct") + F.col("f3_count_pct")) / 3,
        "reaction_family": (F.col("rvol_pct") + F.col("clv_pct") + F.col("ad_pct")) / 3,
        "trend_family": (F.col("rs_pct") + contraction + distance) / 3})
    each = [F.col(f"{n}_family") for n in ("flow", "reaction", "trend")]
    eligible = F.coalesce(F.least(*each) >= p.family_min_pct, F.lit(False))
    for c in each:
        eligible = eligible & c.isNotNull()
    # a geometric mean with floor 1; NULL if a family is
    rank = F.exp(sum((F.ln(F.when(c.isNotNull(), F.greatest(c, F.lit(1.0)))) for c in each), F.lit(0.0)) / 3)
    return out.withColumns({"eligible": eligible, "rank": rank})


def equal_weight_index(features: DataFrame) -> DataFrame:
    """Daily equal-weight index of the universe: (no, day, index, members)."""
    daily = features.filter("in_universe").groupBy("no", "day").agg(F.avg("roc1").alias("ret"), F.count("roc1").alias("members"))
    growth = F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(W.orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    return daily.withColumn("index", 100 * F.exp(growth))


def regime(features: DataFrame, index: DataFrame, p: EodParams = EOD) -> DataFrame:
    """R1 breadth, R2 real flow, R3 index trend, their mean score, and the state after hysteresis.

    An upgrade needs ``confirm_days`` days in a row and a downgrade none, so the state is the lowest of the
    last ``confirm_days`` raw states. One row per day of the market.
    """
    above = F.col("adj_close") > F.col(f"ma{p.slow_ma}")
    daily = features.groupBy("no", "day").agg(
        F.count(F.when(F.col("in_universe") & above, 1)).alias("above"),
        F.count(F.when(F.col("in_universe") & F.col(f"ma{p.slow_ma}").isNotNull(), 1)).alias("placed"),
        F.sum("nrf_day").alias("nrf"), F.sum("mdv20").alias("mdv"))
    order = W.orderBy("no")
    out = daily.join(index.select("no", "index"), "no", "left")
    ma = F.when(F.count("index").over(order.rowsBetween(1 - p.slow_ma, 0)) == p.slow_ma, F.avg("index").over(order.rowsBetween(1 - p.slow_ma, 0)))
    out = out.withColumn("index_ma", ma)
    slope = F.col("index_ma") - F.lag("index_ma", p.slope_days).over(order)
    share = F.when(F.col("placed") > 0, F.col("above") * 100 / F.col("placed"))
    flows = [F.sum("nrf").over(order.rowsBetween(1 - n, 0)) / F.when(F.col("mdv") > 0, F.col("mdv")) for n in p.flow_windows]
    out = out.withColumns({"breadth": share, "slope": slope, "flow_short": flows[0], "flow_long": flows[1]})
    r1 = F.when(F.col("breadth") >= p.breadth_up, 1).when(F.col("breadth") <= p.breadth_down, -1).when(F.col("breadth").isNotNull(), 0)
    r2 = (F.when((F.col("flow_short") > 0) & (F.col("flow_long") > 0), 1).when((F.col("flow_short") < 0) & (F.col("flow_long") < 0), -1)
          .when(F.col("flow_short").isNotNull() & F.col("flow_long").isNotNull(), 0))
    rising, higher = F.col("slope") > 0, F.col("index") > F.col("index_ma")
    r3 = F.when(rising & higher, 1).when((F.col("slope") < 0) & (F.col("index") < F.col("index_ma")), -1).when(F.col("slope").isNotNull(), 0)
    out = out.withColumns({"r1": r1, "r2": r2, "r3": r3})
    out = out.withColumn("score", (F.col("r1") + F.col("r2") + F.col("r3")) / 3)
    raw = F.when(F.col("score") >= p.risk_on, 2).when(F.col("score") <= p.risk_off, 0).when(F.col("score").isNotNull(), 1)
    out = out.withColumn("raw", raw)
    held = F.min("raw").over(order.rowsBetween(1 - p.confirm_days, 0))
    names = F.when(held == 2, "risk_on").when(held == 1, "neutral").otherwise("risk_off")
    return out.withColumn("state", F.when(F.col("raw").isNull(), "unknown").otherwise(names)).select(
        "no", "day", "breadth", "flow_short", "flow_long", "index", "index_ma", "r1", "r2", "r3", "score", "state")


def excess_and_class(norm: DataFrame, index: DataFrame, p: EodParams = EOD) -> DataFrame:
    """P5 excess return over the index and the microstructure class."""
    order = W.orderBy("no")
    moves = index.select("no", (F.col("index") / F.lag("index", p.er_days).over(order) - 1).alias("index_roc"))
    out = norm.join(moves, "no", "left").withColumn("er", F.col(f"roc{p.er_days}") - F.col("index_roc"))
    out = out.withColumn("er_pct", percentile("er", ["day"], F.col("in_universe"), p.min_cross_section))
    flow, er = F.col("f1_pct"), F.col("er_pct")
    lo, hi = p.thin_flow_pct
    cls = (F.when((flow >= p.absorption_flow_pct) & (F.col("er") * 100 <= p.absorption_er_pct), "absorption")
           .when((flow >= lo) & (flow <= hi) & (er >= p.thin_er_pct), "thin_supply")
           .when((er >= p.no_flow_er_pct) & (F.col("f1") <= 0), "no_real_flow").otherwise("neutral"))
    return out.withColumn("mic_class", F.when(flow.isNotNull() & er.isNotNull(), cls))


def setups(scored: DataFrame, p: EodParams = EOD) -> DataFrame:
    """G1: quiet accumulation up to the day before, and a close-confirmed breakout today; with order cap and stop."""
    s = _s()

    def yesterday(c: Column) -> Column:
        return F.lag(c).over(s)

    ready = (F.col("gate") & (F.col("ad_pct") >= p.g1_ad_pct) & (F.col("f3_count") >= p.g1_persistence) & (F.col("atr_ratio") <= p.g1_atr_ratio)
             & (F.col("vol_dryup") <= p.g1_vol_dryup) & (F.col(f"roc{p.er_days}") * 100 < p.g1_ret_pct))
    out = scored.withColumn("ready", F.coalesce(ready, F.lit(False)))
    atr = F.col(f"atr{p.atr_risk}") * F.col("g")
    out = out.withColumns({
        "setup": F.coalesce(yesterday(F.col("ready")), F.lit(False)), "level": F.max("adj_high").over(s.rowsBetween(-p.g1_level_days, -1)),
        "cap": F.floor(F.col("pc") + p.g1_cap_atr * atr), "stop": F.floor(F.min("adj_low").over(s.rowsBetween(1 - p.stop_days, 0)) * F.col("g")) - 1})
    trigger = (F.col("adj_close") > F.col("level")) & (F.col("pl") > F.col("pc")) & (F.col("rvol") >= p.g1_rvol)
    small = F.col("cap") - F.col("stop") <= p.max_stop_atr * atr
    return out.withColumns({"trigger": F.coalesce(trigger, F.lit(False)), "stop_fits": F.coalesce(small, F.lit(False))})


def vetoes(scored: DataFrame, p: EodParams = EOD) -> DataFrame:
    """M2 absorption and M3 hidden distribution (its window ends the day before); near misses with the rule code."""
    i = _i()
    sellers = F.avg("sell_i_count").over(i.rangeBetween(-p.m3_days, -1))
    weak = F.when(F.col("pl") < F.col("pc"), 1).otherwise(0)
    hidden = ((F.col("sell_i_count") >= p.m3_sellers * sellers) & (F.col("buyer_power") >= p.m3_power)
              & (F.sum(weak).over(i.rowsBetween(1 - p.m3_weak_days, 0)) == p.m3_weak_days))
    out = scored.withColumn("_hidden", F.coalesce(hidden, F.lit(False)))
    out = out.withColumns({"m2": F.coalesce(F.col("mic_class") == "absorption", F.lit(False)), "m3": F.coalesce(F.lag("_hidden").over(i), F.lit(False))})
    codes = F.array_compact(F.array(F.when(~F.col("u4"), F.lit("U4")), F.when(F.col("m2"), F.lit("M2")), F.when(F.col("m3"), F.lit("M3"))))
    near = F.least("flow_family", "reaction_family", "trend_family") >= p.near_miss_pct
    whole = F.col("flow_family").isNotNull() & F.col("reaction_family").isNotNull() & F.col("trend_family").isNotNull()
    return out.withColumn("codes", codes).withColumn("near_miss", F.coalesce(near & whole & (F.size("codes") == 1), F.lit(False))).drop("_hidden")


def display_indicators(adjusted: DataFrame) -> DataFrame:
    """RSI 14 (Wilder), MFI 14, MACD 12/26/9, Stochastic 14/3/3 and numeric candle patterns."""
    s = _s()
    move = F.col("adj_close") - F.lag("adj_close").over(s)
    typical = (F.col("adj_high") + F.col("adj_low") + F.col("adj_close")) / 3
    out = adjusted.withColumns({"_up": F.greatest(F.coalesce(move, F.lit(0.0)), F.lit(0.0)), "_down": F.greatest(-F.coalesce(move, F.lit(0.0)), F.lit(0.0)),
                                "_typical": typical})
    out = wilder(wilder(out, "_up", "_gain", 14), "_down", "_loss", 14)
    out = wilder(wilder(out, "adj_close", "_ema12", 12, 2 / 13), "adj_close", "_ema26", 26, 2 / 27)
    money = F.col("_typical") * F.col("adj_volume")
    up = F.col("_typical") > F.lag("_typical").over(s)
    down = F.col("_typical") < F.lag("_typical").over(s)
    last14 = s.rowsBetween(-13, 0)
    out = out.withColumns({"_pos_now": F.when(up, money).otherwise(0.0), "_neg_now": F.when(down, money).otherwise(0.0)})
    pos, neg = F.sum("_pos_now").over(last14), F.sum("_neg_now").over(last14)
    low14, high14 = F.min("adj_low").over(last14), F.max("adj_high").over(last14)
    out = out.withColumns({
        "rsi": F.when(F.col("_gain") + F.col("_loss") > 0, 100 * F.col("_gain") / (F.col("_gain") + F.col("_loss"))),
        "mfi": _when_warm(15, F.when(pos + neg > 0, 100 * pos / (pos + neg))), "macd": F.col("_ema12") - F.col("_ema26"),
        "_k": _when_warm(14, F.when(high14 > low14, 100 * (F.col("adj_close") - low14) / (high14 - low14)))})
    # the signal line starts with the mean of the first nine MACD values
    macd = out.withColumn("_all_idx", F.col("idx")).withColumn("idx", F.col("idx") - 25)
    macd = wilder(macd, "macd", "macd_signal", 9, 2 / 10).withColumn("idx", F.col("_all_idx")).drop("_all_idx")
    last3 = s.rowsBetween(-2, 0)
    macd = macd.withColumn("stoch_k", F.when(F.count("_k").over(last3) == 3, F.avg("_k").over(last3)))
    macd = macd.withColumn("stoch_d", F.when(F.count("stoch_k").over(last3) == 3, F.avg("stoch_k").over(last3)))
    o, h, lo, c = (F.col(x) for x in ("adj_open", "adj_high", "adj_low", "adj_last"))
    body, span = F.abs(c - o), h - lo
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    po, pc = F.lag("adj_open").over(s), F.lag("adj_last").over(s)
    candle = (F.when(span <= 0, None).when(body <= 0.1 * span, "doji")
              .when((lower >= 2 * body) & (upper <= 0.3 * body), "hammer").when((upper >= 2 * body) & (lower <= 0.3 * body), "shooting_star")
              .when((c > o) & (pc < po) & (o <= pc) & (c >= po), "bullish_engulfing").when((c < o) & (pc > po) & (o >= pc) & (c <= po), "bearish_engulfing"))
    return macd.withColumn("candle", candle).drop(*[x for x in macd.columns if x.startswith("_")])
