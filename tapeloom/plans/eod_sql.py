"""DuckDB statements for the end-of-day tables."""

from __future__ import annotations

from tapeloom.operators.eod import EodParams, scored_features
from tapeloom.sources.bindings import BAR_PARAMS

P = EodParams(**BAR_PARAMS)
NEAR, FAR = P.high_days

BARS = """
li AS (
  SELECT 'B' || (l_suppkey % 10) AS ins, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS qty,
    2000 + CAST(round(l_extendedprice / l_quantity) AS BIGINT) % 200 AS price, l_orderkey AS ok, l_linenumber AS ln, l_returnflag IN ('A', 'N') AS buys, l_linestatus = 'O' AS sells
  FROM lineitem),
daily AS (
  SELECT ins, day, min(struct_pack(a := ok, b := ln, c := price)).c AS pf, max(struct_pack(a := ok, b := ln, c := price)).c AS pl, min(price) AS pmin, max(price) AS pmax,
    count(*) AS tno, CAST(sum(qty) AS BIGINT) AS tvol, CAST(sum(qty * price) AS BIGINT) AS tval,
    CAST(coalesce(sum(qty) FILTER (buys), 0) AS BIGINT) AS buy_i_vol, CAST(coalesce(sum(qty) FILTER (sells), 0) AS BIGINT) AS sell_i_vol,
    CAST(coalesce(sum(qty * price) FILTER (buys), 0) AS BIGINT) AS buy_i_value, CAST(coalesce(sum(qty * price) FILTER (sells), 0) AS BIGINT) AS sell_i_value,
    count(*) FILTER (buys) AS buy_i_count, count(*) FILTER (sells) AS sell_i_count
  FROM li GROUP BY ins, day),
closed AS (SELECT *, tval // tvol AS pc, date_diff('day', DATE '1995-01-01', day) AS dn FROM daily),
bars AS (
  SELECT * EXCLUDE (dn, yc), CASE WHEN dn % 1361 = 0 THEN yc * 2 WHEN dn % 389 = 0 THEN yc // 2 ELSE yc END AS py, dense_rank() OVER (ORDER BY day) AS no
  FROM (SELECT *, coalesce(lag(pc) OVER (PARTITION BY ins ORDER BY day), pc) AS yc FROM closed))"""

ADJUSTED = f"""
factors AS (
  SELECT *, CASE WHEN before IS NOT NULL AND py <> before THEN CAST(py AS DOUBLE) / before END AS factor
  FROM (SELECT *, lag(pc) OVER (PARTITION BY ins ORDER BY no) AS before FROM bars)),
reviewed AS (
  SELECT *, factor IS NOT NULL AND (factor < {P.review_min} OR factor > {P.review_max}) AS review,
    coalesce(CASE WHEN NOT (factor < {P.review_min} OR factor > {P.review_max}) THEN factor END, 1.0) AS f FROM factors),
segs AS (
  SELECT *, CAST(sum(CAST(review AS INT)) OVER w AS BIGINT) AS seg, exp(sum(ln(f)) OVER w) AS g FROM reviewed WINDOW w AS (PARTITION BY ins ORDER BY no ROWS UNBOUNDED PRECEDING)),
adj AS (
  SELECT *, pc / g AS adj_close, pl / g AS adj_last, pmax / g AS adj_high, pmin / g AS adj_low, pf / g AS adj_open, tvol * g AS adj_volume,
    row_number() OVER (PARTITION BY ins, seg ORDER BY no) - 1 AS idx,
    CASE WHEN pmin = pmax THEN CASE WHEN pc > py THEN 'up' WHEN pc < py THEN 'down' ELSE 'flat' END END AS lock FROM segs)"""

_S = "OVER (PARTITION BY ins, seg ORDER BY no"


def _warm(n: int, value: str) -> str:
    return f"CASE WHEN idx >= {n - 1} THEN {value} END"


def fold(name: str, source: str, value: str, n: int, alpha: float, offset: int = 0) -> str:
    """Row-by-row exponential smoothing started with the mean of the first n values."""
    return f"""
{name}_in AS (SELECT ins, seg, no, idx - {offset} AS i, {value} AS x, avg({value}) {_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM {source}),
{name} AS (
  SELECT ins, seg, no, i, m AS v FROM {name}_in WHERE i = {n - 1}
  UNION ALL SELECT x.ins, x.seg, x.no, x.i, p.v + {alpha!r} * (x.x - p.v) FROM {name} p JOIN {name}_in x ON x.ins = p.ins AND x.seg = p.seg AND x.i = p.i + 1)"""


PRICES = f"""
px0 AS (
  SELECT *, CASE WHEN pa IS NULL THEN adj_high - adj_low ELSE greatest(adj_high - adj_low, abs(adj_high - pa), abs(adj_low - pa)) END AS tr,
    CASE WHEN no - min(no) OVER (PARTITION BY ins) >= {P.mdv_days} THEN median(tval) OVER (PARTITION BY ins ORDER BY no RANGE BETWEEN {P.mdv_days} PRECEDING AND 1 PRECEDING) END AS mdv20,
    {', '.join(_warm(n, f'avg(adj_close) {_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)') + f' AS ma{n}' for n in (P.fast_ma, P.slow_ma))},
    {', '.join(f'adj_close / lag(adj_close, {n}) {_S}) - 1 AS roc{n}' for n in (1, P.er_days, *P.rs_weights))},
    count(*) FILTER (lock = 'down') OVER (PARTITION BY ins ORDER BY no RANGE BETWEEN {P.lock_days - 1} PRECEDING AND CURRENT ROW) AS down_lock_days
  FROM (SELECT *, lag(adj_close) {_S}) AS pa FROM adj)),
{','.join(fold(f'fold{n}', 'px0', 'tr', n, 1.0 / n) for n in (P.atr_short, P.atr_risk, P.atr_long))},
px AS (
  SELECT p.*, {', '.join(f'f{n}.v AS atr{n}' for n in (P.atr_short, P.atr_risk, P.atr_long))}, f{P.atr_risk}.v / adj_close AS atr_pct FROM px0 p
  {' '.join(f'LEFT JOIN fold{n} f{n} ON f{n}.ins = p.ins AND f{n}.no = p.no' for n in (P.atr_short, P.atr_risk, P.atr_long))})"""


def flow(source: str = "px", name: str = "fl", value_basis: bool = False) -> str:
    nrf = "CAST(buy_i_value - sell_i_value AS DOUBLE)" if value_basis else "CASE WHEN tvol > 0 THEN (buy_i_vol - sell_i_vol) * (CAST(tval AS DOUBLE) / tvol) END"
    b, s = ("buy_i_value", "sell_i_value") if value_basis else ("buy_i_vol", "sell_i_vol")
    w = f"OVER (PARTITION BY ins ORDER BY no RANGE BETWEEN {P.flow_days - 1} PRECEDING AND CURRENT ROW)"
    return f"""
{name}0 AS (SELECT *, {nrf} AS nrf_day, CASE WHEN {b} > 0 AND {s} > 0 AND buy_i_count > 0 AND sell_i_count > 0
  THEN (CAST({b} AS DOUBLE) / buy_i_count) / (CAST({s} AS DOUBLE) / sell_i_count) END AS buyer_power FROM {source}),
{name}1 AS (SELECT *, coalesce(nrf_day > 0 AND buyer_power > {P.strong_power}, false) AS strong FROM {name}0),
{name}2 AS (SELECT *, no - row_number() OVER (PARTITION BY ins, strong ORDER BY no) AS island FROM {name}1),
{name} AS (
  SELECT * EXCLUDE (island), count(nrf_day) {w} AS valid_days, count(*) FILTER (strong) {w} AS f3_count,
    CASE WHEN count(nrf_day) {w} >= {P.flow_min_days} AND mdv20 > 0 THEN sum(nrf_day) {w} / mdv20 END AS f1, buyer_power AS f2,
    CASE WHEN strong THEN least(row_number() OVER (PARTITION BY ins, strong, island ORDER BY no), {P.flow_days}) ELSE 0 END AS f3_run,
    CASE WHEN tvol > 0 THEN CAST(buy_i_vol - sell_i_vol AS DOUBLE) / tvol END AS f5
  FROM {name}2)"""


_RV = f"OVER (PARTITION BY ins ORDER BY no RANGE BETWEEN {P.rvol_days} PRECEDING AND 1 PRECEDING)"
_AD = f"OVER (PARTITION BY ins ORDER BY no RANGE BETWEEN {P.ad_days - 1} PRECEDING AND CURRENT ROW)"
REACTION = f"""
re0 AS (
  SELECT *, CASE WHEN count(tvol) {_RV} >= {P.rvol_min_days} THEN tvol / median(tvol) {_RV} END AS rvol,
    CASE WHEN pmax > pmin THEN CAST((pl - pmin) - (pmax - pl) AS DOUBLE) / (pmax - pmin) END AS clv FROM fl),
re AS (
  SELECT *, CASE WHEN count(clv) {_AD} >= {P.ad_min_days} THEN sum(clv * tvol) {_AD} / sum(CASE WHEN clv IS NOT NULL THEN tvol END) {_AD} END AS ad,
    coalesce(rvol >= {P.quiet_rvol} AND (abs(roc1) * 100 <= {P.quiet_ret_pct} OR lock IS NOT NULL), false) AS quiet FROM re0)"""

TREND = f"""
tn AS (
  SELECT *, {' + '.join(f'{w!r} * roc{n}' for n, w in P.rs_weights.items())} AS rs,
    (adj_close > ma{P.fast_ma}) AND (ma{P.fast_ma} > ma{P.slow_ma}) AND (ma{P.slow_ma} - lag(ma{P.slow_ma}, {P.slope_days}) {_S}) >= -1e-9 * ma{P.slow_ma}) AS gate,
    atr{P.atr_short} / CASE WHEN atr{P.atr_long} > 0 THEN atr{P.atr_long} END AS atr_ratio,
    {_warm(P.vol_long, f'avg(adj_volume) {_S} ROWS BETWEEN {P.vol_short - 1} PRECEDING AND CURRENT ROW) / avg(adj_volume) {_S} ROWS BETWEEN {P.vol_long - 1} PRECEDING AND CURRENT ROW)')} AS vol_dryup,
    {', '.join(_warm(n, f'adj_close / max(adj_high) {_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) - 1') + f' AS dist{n}' for n in P.high_days)}
  FROM re)"""


def pct(value: str, among: str = "true", min_n: int = 2, day: str = "day") -> str:
    """C1 percentile with average ranks."""
    ok = f"({value} IS NOT NULL AND coalesce({among}, false))"
    part = f"PARTITION BY {day}, {ok}"
    n = f"count(*) OVER ({part})"
    return (f"CASE WHEN {ok} AND {n} >= {max(min_n, 2)} THEN 100.0 * (rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({part}, {value}) - 1) / 2.0 - 1)"
            f" / ({n} - 1) END")


UNIVERSE = f"""
un0 AS (
  SELECT *, count(*) OVER (PARTITION BY ins ORDER BY no RANGE BETWEEN {P.lookback_days - 1} PRECEDING AND CURRENT ROW) >= {P.min_trading_days} AS u1,
    CASE WHEN no - lag(no) OVER (PARTITION BY ins ORDER BY no) - 1 >= {P.halt_days} THEN no END AS reopened, NOT review AS u6, {pct('mdv20')} AS value_pct FROM tn),
un AS (
  SELECT * EXCLUDE (reopened), coalesce(value_pct >= {P.min_value_pct}, false) AS u2,
    coalesce(no - last_value(reopened IGNORE NULLS) OVER (PARTITION BY ins ORDER BY no ROWS UNBOUNDED PRECEDING) >= {P.cooldown_days}, true) AS u4 FROM un0),
uni AS (SELECT *, u1 AND u2 AND u6 AS in_universe FROM un)"""

NORMALIZED = f"""
nm AS (SELECT *, {', '.join(f"{pct(c, 'in_universe', P.min_cross_section)} AS {c}_pct" for c in scored_features(P))} FROM uni),
fam0 AS (
  SELECT *, (f1_pct + f2_pct + f3_count_pct) / 3 AS flow_family, (rvol_pct + clv_pct + ad_pct) / 3 AS reaction_family,
    (rs_pct + ((100 - atr_ratio_pct) + (100 - vol_dryup_pct)) / 2 + (dist{NEAR}_pct + dist{FAR}_pct) / 2) / 3 AS trend_family FROM nm),
fam AS (
  SELECT *, coalesce(flow_family >= {P.family_min_pct} AND reaction_family >= {P.family_min_pct} AND trend_family >= {P.family_min_pct}, false) AS eligible,
    exp((ln(CASE WHEN flow_family > 1 THEN flow_family ELSE CASE WHEN flow_family IS NOT NULL THEN 1.0 END END)
       + ln(CASE WHEN reaction_family > 1 THEN reaction_family ELSE CASE WHEN reaction_family IS NOT NULL THEN 1.0 END END)
       + ln(CASE WHEN trend_family > 1 THEN trend_family ELSE CASE WHEN trend_family IS NOT NULL THEN 1.0 END END)) / 3) AS "rank" FROM fam0)"""

INDEX = """
idx0 AS (SELECT no, day, avg(roc1) AS ret, count(roc1) AS members FROM uni WHERE in_universe GROUP BY no, day),
idx AS (SELECT no, day, members, ret, 100 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING)) AS "index" FROM idx0)"""

_O = "OVER (ORDER BY no ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"
REGIME = f"""
rg0 AS (
  SELECT no, day, count(*) FILTER (in_universe AND adj_close > ma{P.slow_ma}) AS above, count(*) FILTER (in_universe AND ma{P.slow_ma} IS NOT NULL) AS placed,
    sum(nrf_day) AS nrf, sum(mdv20) AS mdv FROM uni GROUP BY no, day),
rg1 AS (
  SELECT r.*, i."index", CASE WHEN count(i."index") {_O.format(P.slow_ma - 1)} = {P.slow_ma} THEN avg(i."index") {_O.format(P.slow_ma - 1)} END AS index_ma
  FROM rg0 r LEFT JOIN (SELECT no AS ino, "index" FROM idx) i ON i.ino = r.no),
rg2 AS (
  SELECT *, index_ma - lag(index_ma, {P.slope_days}) OVER (ORDER BY no) AS slope, CASE WHEN placed > 0 THEN above * 100.0 / placed END AS breadth,
    sum(nrf) {_O.format(P.flow_windows[0] - 1)} / CASE WHEN mdv > 0 THEN mdv END AS flow_short, sum(nrf) {_O.format(P.flow_windows[1] - 1)} / CASE WHEN mdv > 0 THEN mdv END AS flow_long
  FROM rg1),
rg3 AS (
  SELECT *, CASE WHEN breadth >= {P.breadth_up} THEN 1 WHEN breadth <= {P.breadth_down} THEN -1 WHEN breadth IS NOT NULL THEN 0 END AS r1,
    CASE WHEN flow_short > 0 AND flow_long > 0 THEN 1 WHEN flow_short < 0 AND flow_long < 0 THEN -1 WHEN flow_short IS NOT NULL AND flow_long IS NOT NULL THEN 0 END AS r2,
    CASE WHEN slope > 0 AND "index" > index_ma THEN 1 WHEN slope < 0 AND "index" < index_ma THEN -1 WHEN slope IS NOT NULL THEN 0 END AS r3 FROM rg2),
rg4 AS (SELECT *, (r1 + r2 + r3) / 3.0 AS score FROM rg3),
rg5 AS (SELECT *, CASE WHEN score >= {P.risk_on} THEN 2 WHEN score <= {P.risk_off} THEN 0 WHEN score IS NOT NULL THEN 1 END AS raw FROM rg4),
regime AS (
  SELECT *, CASE WHEN raw IS NULL THEN 'unknown' ELSE ['risk_off', 'neutral', 'risk_on'][CAST(1 + min(raw) {_O.format(P.confirm_days - 1)} AS INT)] END AS state FROM rg5)"""

EXCESS = f"""
er0 AS (
  SELECT f.*, f.roc{P.er_days} - i.index_roc AS er FROM fam f LEFT JOIN (
    SELECT no AS ino, "index" / lag("index", {P.er_days}) OVER (ORDER BY no) - 1 AS index_roc FROM idx) i ON i.ino = f.no),
er1 AS (SELECT *, {pct('er', 'in_universe', P.min_cross_section)} AS er_pct FROM er0),
er AS (
  SELECT *, CASE WHEN f1_pct IS NOT NULL AND er_pct IS NOT NULL THEN CASE WHEN f1_pct >= {P.absorption_flow_pct} AND er * 100 <= {P.absorption_er_pct} THEN 'absorption'
    WHEN f1_pct BETWEEN {P.thin_flow_pct[0]} AND {P.thin_flow_pct[1]} AND er_pct >= {P.thin_er_pct} THEN 'thin_supply'
    WHEN er_pct >= {P.no_flow_er_pct} AND f1 <= 0 THEN 'no_real_flow' ELSE 'neutral' END END AS mic_class FROM er1)"""

SETUPS = f"""
st0 AS (
  SELECT *, coalesce(gate AND ad_pct >= {P.g1_ad_pct} AND f3_count >= {P.g1_persistence} AND atr_ratio <= {P.g1_atr_ratio} AND vol_dryup <= {P.g1_vol_dryup}
      AND roc{P.er_days} * 100 < {P.g1_ret_pct}, false) AS ready, atr{P.atr_risk} * g AS atr_raw FROM er),
st1 AS (
  SELECT *, coalesce(lag(ready) {_S}), false) AS setup, max(adj_high) {_S} ROWS BETWEEN {P.g1_level_days} PRECEDING AND 1 PRECEDING) AS level,
    CAST(floor(pc + {P.g1_cap_atr} * atr_raw) AS BIGINT) AS cap,
    CAST(floor(min(adj_low) {_S} ROWS BETWEEN {P.stop_days - 1} PRECEDING AND CURRENT ROW) * g) AS BIGINT) - 1 AS stop FROM st0),
st AS (SELECT *, coalesce(adj_close > level AND pl > pc AND rvol >= {P.g1_rvol}, false) AS trigger, coalesce(cap - stop <= {P.max_stop_atr} * atr_raw, false) AS stop_fits FROM st1)"""

VETOES = f"""
ve0 AS (
  SELECT *, coalesce(sell_i_count >= {P.m3_sellers} * avg(sell_i_count) OVER (PARTITION BY ins ORDER BY no RANGE BETWEEN {P.m3_days} PRECEDING AND 1 PRECEDING)
      AND buyer_power >= {P.m3_power} AND count(*) FILTER (pl < pc) OVER (PARTITION BY ins ORDER BY no ROWS BETWEEN {P.m3_weak_days - 1} PRECEDING AND CURRENT ROW) = {P.m3_weak_days},
      false) AS hidden, coalesce(mic_class = 'absorption', false) AS m2 FROM st),
ve1 AS (SELECT *, coalesce(lag(hidden) OVER (PARTITION BY ins ORDER BY no), false) AS m3 FROM ve0),
ve AS (
  SELECT *, concat_ws(',', CASE WHEN NOT u4 THEN 'U4' END, CASE WHEN m2 THEN 'M2' END, CASE WHEN m3 THEN 'M3' END) AS codes,
    coalesce(flow_family >= {P.near_miss_pct} AND reaction_family >= {P.near_miss_pct} AND trend_family >= {P.near_miss_pct}, false)
      AND CAST(NOT u4 AS INT) + CAST(m2 AS INT) + CAST(m3 AS INT) = 1 AS near_miss FROM ve1)"""

ORDERS = """
orders_ AS (SELECT CASE WHEN strong THEN 'strong' ELSE 'other' END AS trial, ins, no, cap, stop, level * g AS level FROM st WHERE cap IS NOT NULL AND stop IS NOT NULL)"""

FILLS = """
fills0 AS (
  SELECT o.trial, o.ins, o.no, o.cap, o.stop, n.no AS entry_no, n.pf AS opened, n.pmin AS e_pmin, n.pmax AS e_pmax, n.lock AS e_lock, n.g AS e_g, n.seg AS e_seg,
    CASE WHEN n.seg = b.seg THEN n.g / b.g END AS scale
  FROM orders_ o JOIN adj b ON b.ins = o.ins AND b.no = o.no LEFT JOIN adj n ON n.ins = o.ins AND n.no = o.no + 1),
fills1 AS (
  SELECT *, CAST(floor(cap * scale + 1e-6) AS BIGINT) AS e_cap, CAST(floor(stop * scale + 1e-6) AS BIGINT) AS e_stop,
    scale IS NULL OR coalesce(e_lock IN ('up', 'flat'), false) AS dead, coalesce(e_lock = 'down', false) AS locked FROM fills0),
fills AS (
  SELECT *, CASE WHEN dead THEN NULL WHEN locked THEN e_pmin WHEN opened <= e_cap THEN opened WHEN e_pmin <= e_cap THEN e_cap END AS fill_base,
    CASE WHEN dead THEN NULL WHEN locked THEN e_pmin WHEN opened = e_pmax THEN CASE WHEN e_pmin <= e_cap THEN e_cap END WHEN opened <= e_cap THEN opened
      WHEN e_pmin <= e_cap THEN e_cap END AS fill_conservative FROM fills1)"""

RETURNS = f"""
rets AS (
  SELECT f.trial, f.ins, f.no, f.entry_no, h.h, f.fill_conservative AS fill, x.pc / (f.fill_conservative * x.g / f.e_g) - 1 - {P.cost_pct!r} / 100 AS net,
    x.pc / (f.fill_conservative * x.g / f.e_g) - 1 - {P.cost_pct!r} / 100 - (ie."index" / ib."index" - 1) AS excess
  FROM fills f CROSS JOIN (SELECT unnest({list(P.horizons)}) AS h) h JOIN adj x ON x.ins = f.ins AND x.no = f.entry_no + h.h AND x.seg = f.e_seg
  LEFT JOIN idx ie ON ie.no = f.entry_no + h.h LEFT JOIN idx ib ON ib.no = f.entry_no - 1 WHERE f.fill_conservative IS NOT NULL)"""

BARRIERS = f"""
tb0 AS (
  SELECT f.trial, f.ins, f.no, f.entry_no, f.fill_conservative AS fill, f.e_stop AS stop, x.no AS d, x.g / f.e_g AS s, x.pc, x.pmin, x.pmax,
    coalesce(x.lock IN ('down', 'flat'), false) AS stuck
  FROM fills f JOIN adj x ON x.ins = f.ins AND x.no > f.entry_no AND x.no <= f.entry_no + 10 AND x.seg = f.e_seg
  WHERE f.fill_conservative > f.e_stop),
tb1 AS (
  SELECT *, pc / s AS close, CASE WHEN pmin <= (fill - {P.stop_r} * (fill - stop)) * s THEN 'stop' WHEN pmax >= (fill + {P.target_r} * (fill - stop)) * s THEN 'target' END AS hit FROM tb0),
tb2 AS (
  SELECT trial, ins, no, entry_no, fill, stop, min(d) FILTER (hit IS NOT NULL) AS first_d, max(d) AS last_d, arg_max(close, d) AS last_close,
    max(pmax / s) AS top, min(pmin / s) AS bottom FROM tb1 GROUP BY ALL),
tb3 AS (
  SELECT t.*, x.hit, x.stuck, (SELECT arg_min(y.close, y.d) FROM tb1 y WHERE y.ins = t.ins AND y.no = t.no AND y.d > t.first_d AND NOT y.stuck) AS later
  FROM tb2 t LEFT JOIN tb1 x ON x.ins = t.ins AND x.no = t.no AND x.d = t.first_d),
tb AS (
  SELECT *, CASE WHEN hit IS NULL THEN last_close WHEN hit = 'stop' AND stuck THEN coalesce(later, last_close) WHEN hit = 'target' THEN fill + {P.target_r} * (fill - stop)
    ELSE fill - {P.stop_r} * (fill - stop) END / fill - 1 - {P.cost_pct!r} / 100 AS net FROM tb3)"""

NEWEY = f"""
nw0 AS (SELECT trial, h, no, avg(excess) AS x, count(*) AS n FROM rets WHERE excess IS NOT NULL GROUP BY ALL),
nw1 AS (SELECT *, x - avg(x) OVER (PARTITION BY trial, h) AS e FROM nw0),
nw2 AS (
  SELECT *, {' + '.join(f"CASE WHEN h > {j} THEN {'1.0' if j == 0 else f'2 * (1 - {j} / CAST(h AS DOUBLE))'} * e * coalesce(lag(e, {j}) OVER (PARTITION BY trial, h ORDER BY no), 0) ELSE 0 END" for j in range(max(P.horizons)))} AS s FROM nw1),
nw AS (
  SELECT trial, h, count(*) AS days, CAST(sum(n) AS BIGINT) AS events, avg(x) AS mean, CASE WHEN sum(s) > 0 THEN sqrt(sum(s) / count(*) / count(*)) END AS se FROM nw2 GROUP BY ALL)"""

# p values by Simpson's rule over the density, another way than the operator's; t in at most 20,000 steps
FDR = f"""
fd0 AS (
  SELECT trial, h, events, mean / se AS t, days - 1 AS nu, events >= {P.min_events} AS enough,
    exp(lgamma(days / 2.0) - lgamma((days - 1) / 2.0)) / sqrt((days - 1) * pi()) AS c FROM nw),
fd1 AS (
  SELECT *, 0.5 - c * t / 60000 * list_sum(list_transform(range(20001), lambda i:
    CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 20000, 2) / nu, -(nu + 1) / 2.0))) AS p FROM fd0),
fd2 AS (SELECT *, CASE WHEN enough THEN coalesce(p, 1.0) ELSE 1.0 END AS used FROM fd1),
fd3 AS (SELECT *, row_number() OVER (ORDER BY used, trial, h) AS place, count(*) OVER () AS tests FROM fd2),
fd4 AS (SELECT *, least(min(used * tests / place) OVER (ORDER BY place DESC ROWS UNBOUNDED PRECEDING), 1.0) AS p_adjusted FROM fd3),
fdr AS (SELECT *, enough AND p_adjusted <= {P.fdr_q} AS passes FROM fd4)"""

BASE = [BARS, ADJUSTED, PRICES]
FEATURES = [*BASE, flow(), REACTION, TREND, UNIVERSE]
SCORED = [*FEATURES, NORMALIZED, INDEX, EXCESS, SETUPS]
LABELED = [*SCORED, ORDERS, FILLS]
