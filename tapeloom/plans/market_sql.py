"""DuckDB statements for the market queries."""

from __future__ import annotations

from tapeloom.operators.calendar import CLASSES
from tapeloom.operators.market import KPI_CLASSES
from tapeloom.plans import tape_sql as q

KEEP = q.P["keep"]
TRADES = "({0}volume IS NULL OR {0}volume > 0 OR coalesce({0}value, 0) > 0 OR coalesce({0}trade_count, 0) > 0)"

ROWS = f"""
mrows AS (
  SELECT r.*, se.pre_open, se.open, se.close, coalesce(r.source_time < se.open, false) AND {TRADES.format('r.')} AS carried
  FROM (SELECT *, {q.day_of('source_time')} AS day FROM real) r LEFT JOIN sess se ON se.class = r.class AND se.day = r.day),
latest AS (
  SELECT * FROM mrows WHERE NOT carried QUALIFY row_number() OVER (PARTITION BY ins_code, day ORDER BY source_time DESC, seq) = 1)"""

REFERENCE = f"""
lasttot AS (SELECT ins_code, day, volume, value, trade_count FROM latest WHERE volume IS NOT NULL AND value IS NOT NULL),
datadays AS (SELECT day, lag(day) OVER (ORDER BY day) AS ended_before FROM (SELECT DISTINCT day FROM lasttot)),
mseen AS (
  SELECT l.*, d.ended_before, lag(l.day) OVER w AS before, lead(l.day) OVER w AS next_day FROM lasttot l JOIN datadays d USING (day)
  WINDOW w AS (PARTITION BY ins_code ORDER BY l.day)),
mruns AS (
  SELECT *, sum(CASE WHEN before <> ended_before AND date_diff('day', before, ended_before) > {KEEP} THEN 1 ELSE 0 END)
    OVER (PARTITION BY ins_code ORDER BY day) AS run FROM mseen),
mkept AS (
  SELECT ins_code, day AS seen_day, next_day, coalesce(last_value(CASE WHEN {q.ACTIVE.format('')} THEN struct_pack(v := volume, a := value, n := trade_count) END
    IGNORE NULLS) OVER (PARTITION BY ins_code, run ORDER BY day ROWS UNBOUNDED PRECEDING), struct_pack(v := volume, a := value, n := trade_count)) AS t FROM mruns),
mdays AS (SELECT d.day, (SELECT max(x.day) FROM datadays x WHERE x.day < d.day) AS ref_day FROM (SELECT DISTINCT day FROM mrows) d),
mreference AS (
  SELECT k.ins_code, d.day, d.ref_day, t.v AS ref_volume, t.a AS ref_value, t.n AS ref_trades FROM mkept k JOIN mdays d
    ON d.ref_day >= k.seen_day AND (k.next_day IS NULL OR d.ref_day < k.next_day) AND d.ref_day <= k.seen_day + {KEEP})"""

ACCEPTED = f"""
mtop AS (
  SELECT m.*, NOT coalesce(m.source_time < m.open, false) AND coalesce((ref_volume <> 0 OR ref_value <> 0 OR coalesce(ref_trades, 0) <> 0)
      AND m.volume = ref_volume AND m.value = ref_value AND coalesce(m.trade_count = ref_trades, true), false) AS repeats,
    max(source_time) OVER (PARTITION BY ins_code, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM mrows m LEFT JOIN mreference USING (ins_code, day) WHERE NOT carried),
mnew AS (
  SELECT *, lag(volume) OVER w AS volume_before, last_value(CASE WHEN volume IS NOT NULL AND value IS NOT NULL THEN repeats END IGNORE NULLS)
    OVER (PARTITION BY ins_code, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS waiting
  FROM mtop WHERE top IS NULL OR source_time > top WINDOW w AS (PARTITION BY ins_code, day ORDER BY seq)),
maccepted AS (
  SELECT *, NOT repeats AND NOT ((volume IS NULL OR value IS NULL) AND coalesce(waiting, false)) AS counted FROM mnew),
states AS (
  SELECT l.*, a.ever_traded, coalesce(a.awaiting, false) AS awaiting FROM latest l JOIN (
    SELECT ins_code, day, bool_or(counted AND {TRADES.format('')}) AS ever_traded,
      arg_max(CASE WHEN repeats THEN 1 ELSE 0 END, CASE WHEN volume IS NOT NULL AND value IS NOT NULL THEN seq END) = 1 AS awaiting
    FROM maccepted GROUP BY ins_code, day) a USING (ins_code, day))"""

TABLE = f"""
icounts AS (SELECT ins_code, {q.day_of('"at"')} AS day, count(*) AS issues FROM issues WHERE code <> 'SOURCE_TIME_ESTIMATED' GROUP BY ALL),
mtable AS (
  SELECT s.*, g.ins_code IS NOT NULL AS game, g.as_of AS g_as_of, g.volume AS g_volume, g.net_hot AS g_net_hot, g.net_hot_plus AS g_net_hot_plus,
    g.net_retail AS g_net_retail, g.net_unattributed AS g_net_unattributed, g.partial AS g_partial, coalesce(i.issues, 0) AS issues,
    coalesce({' AND '.join(f's.{f} IS NOT NULL' for f in q._FLOW)} AND s.volume > g.volume AND s.source_time - g.as_of > INTERVAL 30 SECOND, false) AS lagging
  FROM states s LEFT JOIN games g ON g.ins_code = s.ins_code AND g.day = s.day LEFT JOIN icounts i ON i.ins_code = s.ins_code AND i.day = s.day),
mmarket AS (
  SELECT ins_code AS ins, symbol AS sym, class, day, CASE WHEN NOT awaiting AND price_last > 0 THEN price_last END AS last,
    CASE WHEN NOT awaiting AND ever_traded AND price_last > 0 AND price_yesterday > 0
      THEN CAST(price_last - price_yesterday AS DOUBLE) / price_yesterday * 100 END AS chg,
    CASE WHEN NOT awaiting THEN value END AS value, CASE WHEN awaiting THEN NULL WHEN game THEN g_net_hot WHEN NOT ever_traded THEN 0 END AS net_hot,
    CASE WHEN NOT awaiting THEN g_as_of END AS hot_as_of, NOT awaiting AND lagging AS lagging, ever_traded AS traded, awaiting AS awaiting_reset,
    coalesce(NOT awaiting AND g_partial, false) AS partial, source_time AS src, ingest_time AS ing, source_time_estimated AS est, issues,
    CAST(price_limit_min IS NULL AS INT) + CAST(trade_count IS NULL AS INT) + CAST(mtable.value IS NULL AS INT) + CAST(ind_buy_count IS NULL AS INT) AS n_missing
  FROM mtable)"""

_CLASS_ROWS = ", ".join(f"('{c}')" for c in CLASSES)
GIVES = "(NOT awaiting AND (game OR NOT ever_traded))"
FLOWS = f"""
classes(class) AS (VALUES {_CLASS_ROWS}),
flows AS (
  SELECT d.day, c.class, coalesce(a.instruments, 0) AS instruments, coalesce(a.missing, 0) AS missing, coalesce(a.lagging, 0) AS lagging,
    coalesce(a.value_missing, 0) AS value_missing, coalesce(a.awaiting, 0) AS awaiting, a.net_hot, a.net_hot_plus, a.net_retail, a.net_unattributed,
    a.value, coalesce(a.partial, false) AS partial, a.as_of, coalesce(a.est, false) AS est
  FROM (SELECT DISTINCT day FROM mtable) d CROSS JOIN classes c LEFT JOIN (
    SELECT day, class, count(*) AS instruments, count(*) FILTER (NOT awaiting AND NOT game AND ever_traded) AS missing,
      count(*) FILTER ({GIVES} AND lagging) AS lagging, count(*) FILTER ({GIVES} AND value IS NULL) AS value_missing,
      count(*) FILTER (awaiting) AS awaiting,
      {', '.join(f'CAST(sum(coalesce(g_{n}, 0)) FILTER ({GIVES}) AS BIGINT) AS {n}' for n in ['net_hot', 'net_hot_plus', 'net_retail', 'net_unattributed'])},
      CAST(sum(value) FILTER ({GIVES}) AS BIGINT) AS value, bool_or({GIVES} AND coalesce(g_partial, false)) AS partial,
      max(coalesce(g_as_of, source_time)) FILTER ({GIVES}) AS as_of, bool_or({GIVES} AND source_time_estimated) AS est
    FROM mtable GROUP BY day, class) a ON a.day = d.day AND a.class = c.class)"""

_KPI_CASE = " ".join(f"WHEN class IN ({', '.join(chr(39) + c + chr(39) for c in cl)}) THEN '{k}'" for k, cl in KPI_CLASSES.items())
_B = "time_bucket(INTERVAL 10 MINUTE, {0})"
SERIES = f"""
vrows AS (
  SELECT seq, ins_code, day, CASE {_KPI_CASE} END AS kpi, source_time AS t, value, coalesce(volume < volume_before, false) AS fell, open, close,
    {_B.format('source_time')} AS bar, row_number() OVER (PARTITION BY ins_code, day ORDER BY seq) AS n
  FROM maccepted WHERE counted AND value IS NOT NULL AND CASE {_KPI_CASE} END IS NOT NULL),
vfold AS (
  SELECT seq, ins_code, day, kpi, bar, n, value AS base, t AS base_at, CAST(NULL AS TIMESTAMP) AS dip_at, CAST(0 AS BIGINT) AS amount,
    CAST(NULL AS TIMESTAMP) AS mark_from, CASE WHEN value > 0 THEN bar END AS late_until FROM vrows WHERE n = 1
  UNION ALL
  SELECT seq, ins_code, day, kpi, bar, n, CASE WHEN NOT low OR rebase THEN value ELSE base END, CASE WHEN NOT low OR rebase THEN t ELSE base_at END,
    CASE WHEN NOT low OR rebase THEN NULL ELSE coalesce(dip_at, t) END, CASE WHEN low THEN 0 ELSE value - base END,
    CASE WHEN rebase THEN {_B.format('coalesce(dip_at, t)')} WHEN low THEN bar
      WHEN value > base AND epoch_us(till) - epoch_us(since) > {q.P['gap_after'] * 1_000_000} AND {_B.format('till')} > {_B.format('since')}
        THEN {_B.format('since')} WHEN dip_at IS NOT NULL THEN bar END, NULL
  FROM (
    SELECT v.*, f.base, f.base_at, f.dip_at, v.value < f.base AS low, v.value < f.base AND (v.fell OR coalesce(v.bar > {_B.format('f.dip_at')}, false)) AS rebase,
      CASE WHEN v.open > f.base_at THEN v.open ELSE f.base_at END AS since, CASE WHEN v.close < v.t THEN v.close ELSE v.t END AS till
    FROM vfold f JOIN vrows v ON v.ins_code = f.ins_code AND v.day = f.day AND v.n = f.n + 1)),
vsums AS (SELECT kpi, day, bar, CAST(sum(amount) AS BIGINT) AS value FROM vfold GROUP BY ALL),
vmarks AS (
  SELECT DISTINCT kpi, day, unnest(generate_series(mark_from, bar, INTERVAL 10 MINUTE)) AS bar FROM vfold WHERE mark_from IS NOT NULL),
vlate AS (SELECT kpi, day, max(late_until) AS late_until FROM vfold GROUP BY ALL),
series AS (
  SELECT kpi, day, bar, s.value, m.kpi IS NOT NULL OR coalesce(bar <= l.late_until, false) AS partial
  FROM vsums s FULL JOIN (SELECT *, true AS marked FROM vmarks) m USING (kpi, day, bar) JOIN vlate l USING (kpi, day))""".replace(
      "m.kpi IS NOT NULL OR coalesce(bar", "coalesce(marked, false) OR coalesce(bar")

_KPI_ROWS = ", ".join(f"('{k}', '{c}')" for k, cl in KPI_CLASSES.items() for c in cl)
BARS = f"""
kclass(kpi, class) AS (VALUES {_KPI_ROWS}),
vspan AS (
  SELECT s.kpi, s.day, min(s.bar) AS first, max(s.bar) AS last, any_value(l.late_until) AS late_until,
    (SELECT min({_B.format('se.open')}) FROM kclass k JOIN sess se ON se.class = k.class WHERE k.kpi = s.kpi AND se.day = s.day) AS opened
  FROM vsums s JOIN vlate l USING (kpi, day) GROUP BY s.kpi, s.day),
vaxis AS (
  SELECT kpi, day, late_until, unnest(generate_series(CASE WHEN late_until IS NOT NULL AND opened < first THEN opened ELSE first END, last, INTERVAL 10 MINUTE)) AS bar
  FROM vspan),
bars AS (
  SELECT a.kpi, a.day, a.bar, s.value, coalesce(s.partial, a.bar <= a.late_until, false) AS partial FROM vaxis a LEFT JOIN series s USING (kpi, day, bar)
  QUALIFY row_number() OVER (PARTITION BY a.kpi, a.day ORDER BY a.bar DESC) <= 36)"""

BASE = [*q.SNAP_BASE, ROWS]
STATES = [*BASE, REFERENCE, ACCEPTED]
