"""Registered queries over daily bars: end-of-day features, signals, labels and their statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import eod
from tapeloom.operators import eod_labels as lab
from tapeloom.plans import eod_sql as q
from tapeloom.plans import tape_sql
from tapeloom.plans.inputs import shared
from tapeloom.plans.registry import Registry
from tapeloom.runtime import prepare
from tapeloom.sources import bindings


# Results are rounded for comparison; the factor keeps exact halves from falling either way.
SETTLE = 1 + 1e-9


class Bars:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.p = prepare(spark), sf_dir, eod.EodParams(**bindings.BAR_PARAMS)

    def _shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return shared(self.spark, self.sf_dir, name, ["lineitem"], build)

    @property
    def bars(self) -> DataFrame:
        return self._shared("bars", lambda: eod.numbered(bindings.bars(self.spark, self.sf_dir)))

    @property
    def prices(self) -> DataFrame:
        return self._shared("bar-prices", lambda: eod.price_features(eod.adjust_prices(self.bars, self.p), self.p))

    def features_on(self, basis: str) -> DataFrame:
        p = self.p
        return eod.universe(eod.trend_features(eod.reaction_features(eod.flow_features(self.prices, p, basis), p), p), p)

    @property
    def features(self) -> DataFrame:
        return self._shared("bar-features", lambda: self.features_on("volume"))

    @property
    def index(self) -> DataFrame:
        return self._shared("bar-index", lambda: eod.equal_weight_index(self.features))

    @property
    def scored(self) -> DataFrame:
        """Percentiles, families, excess, setups and vetoes."""
        def build() -> DataFrame:
            fam = eod.families(eod.normalized(self.features, self.p), self.p)
            return eod.vetoes(eod.setups(eod.excess_and_class(fam, self.index, self.p), self.p), self.p)

        return self._shared("bar-scored", build)

    @property
    def fills(self) -> DataFrame:
        """Every bar as a signal: one trial for strong flow days, one for the others."""
        trial = F.when(F.col("strong"), "strong").otherwise("other").alias("trial")
        orders = self.scored.filter(F.col("cap").isNotNull() & F.col("stop").isNotNull()).select(
            trial, "ins", "no", "cap", "stop", (F.col("level") * F.col("g")).alias("level"))
        return self._shared("bar-fills", lambda: lab.fills(orders, self.prices))

    @property
    def returns(self) -> DataFrame:
        return lab.forward_returns(self.fills, self.prices, self.index, p=self.p)

    @property
    def barriers(self) -> DataFrame:
        return lab.triple_barrier(self.fills, self.prices, p=self.p)


def register(r: Registry) -> None:
    def add(name: str, build: Callable[[Bars], DataFrame], parts: list[str] | None = None, rounded: dict[str, int] | None = None,
            plain: list[str] | None = None, source: str = "", where: str | None = None, sql_expr: dict[str, str] | None = None) -> None:
        """Select ``plain`` and rounded columns of ``build``; the SQL takes the same columns from ``source``."""
        rounded, plain, exprs = rounded or {}, plain or [], sql_expr or {}

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Bars(spark, sf_dir)).select(*plain, *[F.round(F.col(c) * SETTLE, d).alias(c) for c, d in rounded.items()])

        sql = None
        if parts is not None:
            cols = [f'{exprs[c]} AS "{c}"' if c in exprs else f'"{c}"' for c in plain]
            cols += [f'round(({exprs.get(c, chr(34) + c + chr(34))}) * {SETTLE!r}, {d}) AS "{c}"' for c, d in rounded.items()]
            sql = tape_sql.with_(parts, f"SELECT {', '.join(cols)} FROM {source}" + (f" WHERE {where}" if where else ""))
        r.add(name, query, sql)

    key = ["ins", "day"]
    p = q.P
    add("daily_bars", lambda b: b.bars, [q.BARS], plain=[*key, "no", "pf", "pl", "pc", "py", "pmin", "pmax", "tno", "tvol", "tval", "buy_i_vol", "sell_i_vol",
                                                         "buy_i_value", "sell_i_value", "buy_i_count", "sell_i_count"], source="bars")
    add("adjusted_prices", lambda b: b.prices, [q.BARS, q.ADJUSTED], {"f": 9, "g": 9, "adj_close": 4, "adj_high": 4, "adj_low": 4}, [*key, "review", "seg"], "adj")
    add("lock_days", lambda b: b.prices.filter(F.col("lock").isNotNull()), [q.BARS, q.ADJUSTED], plain=[*key, "lock"], source="adj", where="lock IS NOT NULL")

    def reconciled(b: Bars) -> DataFrame:
        """A second source that disagrees on fixed days."""
        n = F.col("no")
        other = b.bars.withColumns({"pc": F.when(n % 50 == 0, F.expr("pc + pc div 100")).otherwise(F.col("pc")),
                                    "tvol": F.when(n % 70 == 0, F.col("tvol") + 1).otherwise(F.col("tvol"))})
        return eod.reconcile_sources(b.bars, other, b.p)

    add("reconciled_sources", reconciled, [q.BARS, f"""
recon AS (SELECT *, CASE WHEN no % 50 = 0 THEN (pc // 100) * 100.0 / pc > {p.reconcile_pct} ELSE false END AS close_differs,
  CASE WHEN no % 70 = 0 THEN 100.0 / tvol > {p.reconcile_pct} ELSE false END AS volume_differs FROM bars)"""],
        plain=[*key, "close_differs", "volume_differs"], source="recon", where="close_differs OR volume_differs")
    add("median_value_20d", lambda b: b.prices, q.BASE, {"mdv20": 2}, key, "px")
    add("moving_averages", lambda b: b.prices, q.BASE, {f"ma{p.fast_ma}": 3, f"ma{p.slow_ma}": 3, "roc1": 6, f"roc{p.er_days}": 6, "roc20": 6}, key, "px")
    add("average_true_range", lambda b: b.prices, q.BASE, {f"atr{n}": 4 for n in (p.atr_short, p.atr_risk, p.atr_long)}, key, "px")
    add("real_flow_features", lambda b: b.features, q.FEATURES, {"f1": 6, "f2": 6, "f5": 8}, [*key, "valid_days", "f3_count", "f3_run"], "uni")
    add("reaction_features", lambda b: b.features, q.FEATURES, {"rvol": 6, "clv": 8, "ad": 8}, [*key, "quiet"], "uni")
    add("trend_features", lambda b: b.features, q.FEATURES, {"rs": 6, "atr_ratio": 6, "vol_dryup": 6, f"dist{q.NEAR}": 6, f"dist{q.FAR}": 6, "atr_pct": 6},
        [*key, "gate", "down_lock_days"], "uni")
    add("universe_flags", lambda b: b.features, q.FEATURES, {"value_pct": 6}, [*key, "u1", "u2", "u4", "u6", "in_universe"], "uni")
    add("cross_section_percentiles", lambda b: b.scored, [*q.FEATURES, q.NORMALIZED], {f"{c}_pct": 5 for c in eod.scored_features(p)}, key, "nm")
    add("family_scores", lambda b: b.scored, [*q.FEATURES, q.NORMALIZED], {"flow_family": 5, "reaction_family": 5, "trend_family": 5, "rank": 4}, [*key, "eligible"], "fam")
    add("equal_weight_index", lambda b: b.index, [*q.FEATURES, q.INDEX], {"ret": 8, "index": 3}, ["day", "no", "members"], "idx")
    add("market_regime", lambda b: eod.regime(b.features, b.index, b.p), [*q.FEATURES, q.INDEX, q.REGIME],
        {"breadth": 5, "flow_short": 5, "flow_long": 5, "score": 5}, ["day", "r1", "r2", "r3", "state"], "regime")
    add("excess_return_classes", lambda b: b.scored, q.SCORED, {"er": 6, "er_pct": 5}, [*key, "mic_class"], "er")
    add("breakout_setups", lambda b: b.scored, q.SCORED, {"level": 4}, [*key, "setup", "trigger", "stop_fits", "cap", "stop"], "st")
    add("veto_flags", lambda b: b.scored.withColumn("codes", F.array_join("codes", ",")), [*q.SCORED, q.VETOES], plain=[*key, "m2", "m3", "codes", "near_miss"], source="ve")
    add("order_fills", lambda b: b.fills, q.LABELED, plain=["trial", "ins", "no", "entry_no", "e_cap", "e_stop", "fill_base", "fill_conservative"], source="fills")
    add("deferred_sales", lambda b: lab.sell_fills(b.prices), [q.BARS, q.ADJUSTED, """
sales AS (SELECT ins, no, day, first_value(CASE WHEN lock IN ('down', 'flat') THEN NULL ELSE no END IGNORE NULLS) OVER w AS sell_no,
  first_value(CASE WHEN lock IN ('down', 'flat') THEN NULL WHEN lock = 'up' THEN pmax ELSE pf END IGNORE NULLS) OVER w AS sell_price
  FROM adj WINDOW w AS (PARTITION BY ins ORDER BY no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""], plain=[*key, "sell_no", "sell_price"], source="sales")
    add("forward_returns", lambda b: b.returns, [*q.LABELED, q.RETURNS], {"net": 7, "excess": 6}, ["trial", "ins", "no", "h", "fill"], "rets")
    add("barrier_labels", lambda b: b.barriers, [*q.LABELED, q.BARRIERS], {"net": 7, "r_multiple": 5, "mfe": 7, "mae": 7}, ["trial", "ins", "no", "label", "exit_no"], "tb",
        sql_expr={"label": "coalesce(hit, 'time')", "exit_no": "coalesce(first_d, last_d)", "r_multiple": "net * fill / (fill - stop)",
                  "mfe": "top / fill - 1", "mae": "bottom / fill - 1"})
    add("excess_return_tests", lambda b: lab.newey_west(b.returns, b.p), [*q.LABELED, q.RETURNS, q.NEWEY], {"mean": 7, "se": 7, "t": 4}, ["trial", "h", "days", "events"], "nw",
        sql_expr={"t": "mean / se"})
    add("false_discovery_control", lambda b: lab.benjamini_hochberg(lab.newey_west(b.returns, b.p), b.p), [*q.LABELED, q.RETURNS, q.NEWEY, q.FDR],
        {"p": 8, "p_adjusted": 8}, ["trial", "h", "enough", "passes"], "fdr")
    add("flow_basis_gate", lambda b: lab.basis_gate(b.features, b.features_on("value"), b.p), [*q.FEATURES, q.flow("px", "fv", True), f"""
bg0 AS (
  SELECT a.no, {q.pct('a.f1', 'a.in_universe', p.min_cross_section, 'a.no')} AS f1_a, {q.pct('a.f2', 'a.in_universe', p.min_cross_section, 'a.no')} AS f2_a,
    {q.pct('a.f3_count', 'a.in_universe', p.min_cross_section, 'a.no')} AS f3_a, {q.pct('v.f1', 'a.in_universe', p.min_cross_section, 'a.no')} AS f1_b,
    {q.pct('v.f2', 'a.in_universe', p.min_cross_section, 'a.no')} AS f2_b, {q.pct('v.f3_count', 'a.in_universe', p.min_cross_section, 'a.no')} AS f3_b
  FROM uni a JOIN fv v ON v.ins = a.ins AND v.no = a.no),
bg1 AS (SELECT *, (f1_a + f2_a + f3_a) / 3 AS fa, (f1_b + f2_b + f3_b) / 3 AS fb FROM bg0),
bg2 AS (
  SELECT no, corr(f1_a, f1_b) AS f1, corr(f2_a, f2_b) AS f2, count(*) FILTER (fa IS NOT NULL AND fb IS NOT NULL) AS placed,
    count(*) FILTER ((fa >= {p.family_min_pct}) <> (fb >= {p.family_min_pct})) AS flips FROM bg1 GROUP BY no),
bg3 AS (SELECT CASE WHEN isnan(f1) THEN NULL ELSE f1 END AS f1, CASE WHEN isnan(f2) THEN NULL ELSE f2 END AS f2, placed, flips FROM bg2),
gate AS (SELECT avg(f1) AS f1_mean, quantile_cont(f1, 0.05) AS f1_p5, avg(f2) AS f2_mean, quantile_cont(f2, 0.05) AS f2_p5, sum(flips) * 100.0 / sum(placed) AS flip_pct FROM bg3)"""],
        {"f1_mean": 6, "f1_p5": 6, "f2_mean": 6, "f2_p5": 6, "flip_pct": 6}, [], "gate")

    def board(b: Bars) -> DataFrame:
        """Closed signals against their own overall mean and spread."""
        closed = b.barriers
        return lab.scoreboard(closed, closed.groupBy("trial").agg(F.avg("r_multiple").alias("mean"), F.stddev_samp("r_multiple").alias("sd")), b.p)

    w = f"OVER (PARTITION BY c.trial ORDER BY c.exit_no, c.ins, c.no ROWS BETWEEN {p.scoreboard - 1} PRECEDING AND CURRENT ROW)"
    add("signal_scoreboard", board, [*q.LABELED, q.BARRIERS, f"""
shut AS (SELECT trial, ins, no, coalesce(first_d, last_d) AS exit_no, net * fill / (fill - stop) AS r FROM tb),
bt AS (SELECT trial, avg(r) AS m, stddev_samp(r) AS sd FROM shut GROUP BY trial),
live AS (SELECT c.*, count(r) {w} AS n, avg(r) {w} AS live_mean, bt.m, bt.sd FROM shut c JOIN bt USING (trial)),
board0 AS (SELECT *, (live_mean - m) / (sd / sqrt(n)) AS z FROM live),
board AS (SELECT *, CASE WHEN n < {p.scoreboard} THEN 'evaluating' WHEN live_mean < 0 OR z < -2.0 THEN 'suspended' ELSE 'active' END AS status FROM board0)"""],
        {"live_mean": 5, "z": 4}, ["trial", "ins", "no", "exit_no", "n", "status"], "board")
    s = q._S
    add("display_indicators", lambda b: eod.display_indicators(b.prices), [*q.BASE, f"""
di0 AS (
  SELECT *, greatest(coalesce(adj_close - pa, 0), 0) AS up_, greatest(coalesce(pa - adj_close, 0), 0) AS down_, (adj_high + adj_low + adj_close) / 3 AS typical FROM px),
di1 AS (SELECT *, lag(typical) {s}) AS pt, lag(adj_open) {s}) AS po, lag(adj_last) {s}) AS plast FROM di0),
di2 AS (SELECT *, CASE WHEN typical > pt THEN typical * adj_volume ELSE 0 END AS pos, CASE WHEN typical < pt THEN typical * adj_volume ELSE 0 END AS neg FROM di1),
{q.fold('gain', 'di2', 'up_', 14, 1 / 14)}, {q.fold('loss', 'di2', 'down_', 14, 1 / 14)}, {q.fold('e12', 'di2', 'adj_close', 12, 2 / 13)}, {q.fold('e26', 'di2', 'adj_close', 26, 2 / 27)},
di3 AS (
  SELECT d.*, gn.v AS gain, ls.v AS loss, a.v - b.v AS macd,
    sum(pos) OVER w14 AS spos, sum(neg) OVER w14 AS sneg, min(adj_low) OVER w14 AS low14, max(adj_high) OVER w14 AS high14
  FROM di2 d LEFT JOIN gain gn ON gn.ins = d.ins AND gn.no = d.no LEFT JOIN loss ls ON ls.ins = d.ins AND ls.no = d.no
  LEFT JOIN e12 a ON a.ins = d.ins AND a.no = d.no LEFT JOIN e26 b ON b.ins = d.ins AND b.no = d.no
  WINDOW w14 AS (PARTITION BY d.ins, d.seg ORDER BY d.no ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
{q.fold('sig', 'di3', 'macd', 9, 2 / 10, 25)},
di4 AS (SELECT *, CASE WHEN idx >= 13 AND high14 > low14 THEN 100 * (adj_close - low14) / (high14 - low14) END AS k FROM di3),
di5 AS (SELECT *, CASE WHEN count(k) {s} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN avg(k) {s} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS stoch_k FROM di4),
di AS (
  SELECT d.*, sg.v AS macd_signal, CASE WHEN count(stoch_k) {s.replace('ins, seg', 'd.ins, d.seg').replace('BY no', 'BY d.no')} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
      THEN avg(stoch_k) {s.replace('ins, seg', 'd.ins, d.seg').replace('BY no', 'BY d.no')} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS stoch_d,
    CASE WHEN gain + loss > 0 THEN 100 * gain / (gain + loss) END AS rsi, CASE WHEN idx >= 14 AND spos + sneg > 0 THEN 100 * spos / (spos + sneg) END AS mfi,
    abs(adj_last - adj_open) AS body, adj_high - adj_low AS span, adj_high - greatest(adj_open, adj_last) AS upper_, least(adj_open, adj_last) - adj_low AS lower_
  FROM di5 d LEFT JOIN sig sg ON sg.ins = d.ins AND sg.no = d.no),
shown AS (
  SELECT *, CASE WHEN span <= 0 THEN NULL WHEN body <= 0.1 * span THEN 'doji' WHEN lower_ >= 2 * body AND upper_ <= 0.3 * body THEN 'hammer'
    WHEN upper_ >= 2 * body AND lower_ <= 0.3 * body THEN 'shooting_star'
    WHEN adj_last > adj_open AND plast < po AND adj_open <= plast AND adj_last >= po THEN 'bullish_engulfing'
    WHEN adj_last < adj_open AND plast > po AND adj_open >= plast AND adj_last <= po THEN 'bearish_engulfing' END AS candle FROM di)"""],
        {"rsi": 5, "mfi": 4, "macd": 3, "macd_signal": 3, "stoch_k": 4, "stoch_d": 4}, [*key, "candle"], "shown")
