"""DuckDB statements for the tape queries: the same rules written as plain window SQL."""

from __future__ import annotations

from tapeloom.operators.calendar import UNKNOWN
from tapeloom.sources.bindings import DEFECTS, EVENT_CALENDAR, EVENT_PARAMS, REHEARSAL

P = {"hot": 2_000_000_000, "plus": 1_000_000_000, "keep": 30, **EVENT_PARAMS}


def _hours_rows() -> str:
    """Session hours as VALUES rows: class, from, weekday (Monday = 0), pre_open, open, close, verified."""
    rows = []
    for cls in [*EVENT_CALENDAR.class_names(), UNKNOWN]:
        for start, hours in EVENT_CALENDAR.timetable(cls):
            for (pre, op, cl, ok), days in hours.items():
                rows += [f"('{cls}', DATE '{start}', {d}, {pre}, {op}, {cl}, {str(ok).lower()})" for d in days]
    return ", ".join(rows)


def _rule_rows() -> str:
    def s(hm: str) -> int:
        return int(hm[:2]) * 3600 + int(hm[3:]) * 60

    return ", ".join(
        f"('{r.cls}', DATE '{r.effective_from}', {list(r.days)}, {s(r.pre_open)}, {s(r.open)}, "
        f"{s(r.close)}, {str(r.verified).lower()})" for r in EVENT_CALENDAR.rules)


HOLIDAYS = ", ".join(f"DATE '{d}'" for d in EVENT_CALENDAR.holidays)

SNAPS = """
ev AS (
  SELECT event_id AS seq, user_id % 20 AS k, CAST(ts AS DATE) AS d, event_id, event_type,
         CAST(floor(epoch_us(ts) / 1000000.0) - epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) AS s,
         (1 + event_id % 40) * 10000 AS v, 10000 + (event_id * 37) % 400 AS price_last
  FROM events),
ev2 AS (
  SELECT *, CAST(epoch(CAST(d AS TIMESTAMP)) AS BIGINT) + 17700 + (s * 2) // 5 AS tick, v * price_last AS val,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN v ELSE 0 END AS ib,
         CASE WHEN event_type IN ('click', 'error') THEN v ELSE 0 END AS is_, event_id % 3 AS ibc, event_id % 4 AS isc
  FROM ev),
sums AS (
  SELECT seq, k, d, tick, price_last, CAST(sum(v) OVER w AS BIGINT) AS volume, CAST(sum(val) OVER w AS BIGINT) AS value,
         CAST(sum(ib) OVER w AS BIGINT) AS ind_buy_vol, CAST(sum(is_) OVER w AS BIGINT) AS ind_sell_vol,
         CAST(sum(ibc) OVER w AS BIGINT) AS ind_buy_count, CAST(sum(isc) OVER w AS BIGINT) AS ind_sell_count,
         count(*) OVER w AS trade_count, row_number() OVER w AS rn
  FROM ev2 WINDOW w AS (PARTITION BY k, d ORDER BY seq ROWS UNBOUNDED PRECEDING)),
ends AS (
  SELECT k, d, lead(d) OVER (PARTITION BY k ORDER BY d) AS next_d, max(volume) AS volume, max(value) AS value, max(ind_buy_vol) AS ind_buy_vol,
         max(ind_sell_vol) AS ind_sell_vol, max(ind_buy_count) AS ind_buy_count, max(ind_sell_count) AS ind_sell_count,
         max(trade_count) AS trade_count
  FROM sums GROUP BY k, d),
shown AS (
  SELECT s.seq, s.k, s.tick, s.price_last,
    {shown}
  FROM sums s LEFT JOIN ends e ON s.k = e.k AND s.d = e.next_d AND s.rn = 1 AND s.k % 3 = 0),
stamped AS (
  SELECT *, tick + CASE WHEN seq % 97 = 0 THEN 120 ELSE 1 + seq % 7 END AS ing FROM shown),
snaps AS (
  SELECT seq, 'I' || k AS ins_code, 'S' || k AS symbol, CASE WHEN k = 19 AND seq % 4 = 3 THEN 'rebase:feed' ELSE 'feed' END AS source,
    make_timestamp(CASE WHEN k = 17 THEN ing WHEN seq % 61 = 0 THEN tick - 2400 WHEN seq % 499 = 0 THEN tick + 8000 ELSE tick END * 1000000) AS source_time,
    make_timestamp(ing * 1000000) AS ingest_time, k = 17 AS source_time_estimated, price_last, CAST(10200 AS BIGINT) AS price_yesterday,
    CASE WHEN k <> 11 THEN CAST(10050 AS BIGINT) END AS price_limit_min, CASE WHEN k <> 11 THEN CAST(10350 AS BIGINT) END AS price_limit_max,
    CASE WHEN k <> 14 THEN trade_count END AS trade_count, CASE WHEN seq % 89 = 0 THEN volume - 500000 ELSE volume END AS volume,
    CASE WHEN seq % 131 <> 0 THEN value END AS value, ind_buy_vol, ind_sell_vol,
    volume - ind_buy_vol + CASE WHEN seq % 101 = 0 THEN 10 ELSE 0 END AS inst_buy_vol, volume - ind_sell_vol AS inst_sell_vol,
    CASE WHEN seq % 53 <> 0 THEN ind_buy_count END AS ind_buy_count, ind_sell_count,
    CASE k % 7 WHEN 0 THEN 'stock' WHEN 1 THEN 'stock' WHEN 2 THEN 'equity_etf' WHEN 3 THEN 'fixed_income' WHEN 4 THEN 'gold'
      WHEN 5 THEN 'silver' ELSE 'unknown' END AS class
  FROM stamped)""".replace("{shown}", ",\n    ".join(
    f"CASE WHEN s.rn = 1 AND s.k % 3 = 1 THEN 0 WHEN e.k IS NOT NULL THEN e.{c} ELSE s.{c} END AS {c}"
    for c in ["volume", "value", "ind_buy_vol", "ind_sell_vol", "ind_buy_count", "ind_sell_count", "trade_count"]))



def _on(case: str) -> str:
    key, modulo, rest = REHEARSAL[case]
    return f"(k = {key} AND n % {modulo} IN ({', '.join(map(str, rest))}))"


_STILL = {"volume": 5_000_000, "value": 50_000_000_000, "trade_count": 100, "ind_buy_vol": 3_000_000, "ind_sell_vol": 2_000_000, "inst_buy_vol": 2_000_000,
          "inst_sell_vol": 3_000_000, "ind_buy_count": 40, "ind_sell_count": 30}
# The tape with days on which every rule of the market state has something to do.
REHEARSED = SNAPS.replace("\nsnaps AS (", "\nsnaps0 AS (") + f""",
rehearsed0 AS (
  SELECT *, CAST(substr(ins_code, 2) AS INT) AS k, CAST(source_time AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tehran' AS DATE) AS sday FROM snaps0),
rehearsed1 AS (SELECT *, date_diff('day', DATE '2024-01-01', sday) AS n, CAST(epoch(CAST(sday AS TIMESTAMP)) AS BIGINT) - 12600 AS start_ FROM rehearsed0),
rehearsed AS (
  SELECT *, class IN ('gold', 'silver') AND n % 2 = 0 AND row_number() OVER (PARTITION BY ins_code, sday ORDER BY seq) = 1 AS first_ FROM rehearsed1
  WHERE NOT (class IN ('gold', 'silver') AND n % 2 = 0 AND ({' OR '.join(f'seq % {d} = 0' for d in DEFECTS)}))),
snaps AS (
  SELECT seq, ins_code, symbol, source, source_time_estimated, class,
    CASE WHEN first_ THEN make_timestamp((start_ + 30000) * 1000000) WHEN {_on('before_open')}
      THEN make_timestamp((start_ + 3600 + (CAST(floor(epoch(source_time)) AS BIGINT) - start_) // 10) * 1000000)
      WHEN k = 9 AND seq % 53 = 5 THEN source_time + INTERVAL 1 DAY ELSE source_time END AS source_time,
    CASE WHEN first_ THEN make_timestamp((start_ + 30001) * 1000000) ELSE ingest_time END AS ingest_time,
    CASE WHEN NOT {_on('no_price')} THEN price_last END AS price_last, CASE WHEN {_on('flat')} THEN price_last ELSE price_yesterday END AS price_yesterday,
    CASE WHEN NOT {_on('no_limits')} THEN price_limit_min END AS price_limit_min, CASE WHEN NOT {_on('no_limits')} THEN price_limit_max END AS price_limit_max,
    {', '.join(f"CASE WHEN first_ OR {_on('untraded')} THEN 0 WHEN {_on('stands_still')} THEN {v} ELSE {c} END AS {c}" for c, v in _STILL.items())}
  FROM rehearsed)"""

TEHRAN_DAY = "CAST({0} AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tehran' AS DATE)"


def day_of(ts: str) -> str:
    return TEHRAN_DAY.format(ts)


def at_second(day: str, seconds: str) -> str:
    """Instant of a second of a Tehran day."""
    return f"(CAST({day} AS TIMESTAMP) AT TIME ZONE 'Asia/Tehran' AT TIME ZONE 'UTC' + to_seconds({seconds}))"


SESSIONS = f"""
hours(class, since, weekday, pre_s, open_s, close_s, verified) AS (VALUES {_hours_rows()}),
alldays AS (SELECT DISTINCT day FROM (SELECT {day_of('source_time')} AS day FROM snaps UNION ALL SELECT {day_of('ingest_time')} FROM snaps)),
newest AS (
  SELECT day, class, max(since) AS since FROM alldays, (SELECT DISTINCT class, since FROM hours) WHERE since <= day GROUP BY day, class),
sess AS (
  SELECT n.day, n.class, {at_second('n.day', 'h.pre_s')} AS pre_open, {at_second('n.day', 'h.open_s')} AS open,
         {at_second('n.day', 'h.close_s')} AS close, h.verified
  FROM newest n JOIN hours h ON h.class = n.class AND h.since = n.since AND h.weekday = isodow(n.day) - 1
  WHERE n.day NOT IN ({HOLIDAYS}))"""

REAL = """
real AS (SELECT * FROM snaps WHERE NOT (source = 'synthetic' OR starts_with(source, 'rebase:') OR starts_with(ins_code, 'SYN') OR starts_with(symbol, 'SYN')))"""

ACTIVE = "({0}volume <> 0 OR {0}value <> 0 OR coalesce({0}trade_count, 0) <> 0)"
_T = ["volume", "value", "trade_count", "ind_buy_vol", "ind_sell_vol", "inst_buy_vol", "inst_sell_vol", "ind_buy_count", "ind_sell_count"]
_FLOW = ["price_last", "volume", "value", "ind_buy_vol", "ind_sell_vol", "ind_buy_count", "ind_sell_count"]
FLOORED = ("(CASE WHEN {open} IS NULL THEN time_bucket(INTERVAL 10 MINUTE, {ts}) ELSE {open} + "
           "to_microseconds(CAST(floor((epoch_us({ts}) - epoch_us({open})) / 600000000.0) AS BIGINT) * 600000000) END)")
WINDOW_START = FLOORED.format(open="open", ts="source_time")

REFERENCE = f"""
rolls AS (
  SELECT day, roll_seq, lead(roll_seq) OVER (ORDER BY roll_seq) AS next_seq FROM (
    SELECT *, max(day) OVER (ORDER BY roll_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (
      SELECT {day_of('source_time')} AS day, min(seq) AS roll_seq FROM real WHERE source_time <= ingest_time + INTERVAL 1 HOUR GROUP BY 1))
  WHERE latest IS NULL OR day > latest),
seen AS (
  SELECT ins_code, day, arg_max(volume, seq) AS volume, arg_max(value, seq) AS value,
         arg_max(struct_pack(c := trade_count), seq).c AS trade_count
  FROM (SELECT r.*, {day_of('source_time')} AS day FROM real r WHERE volume IS NOT NULL AND value IS NOT NULL
          AND source_time <= ingest_time + INTERVAL 1 HOUR) JOIN rolls USING (day)
  WHERE next_seq IS NULL OR seq < next_seq GROUP BY ins_code, day),
runs AS (
  SELECT *, sum(far) OVER (PARTITION BY ins_code ORDER BY day) AS run FROM (
    SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY ins_code ORDER BY day), day) > {P['keep']} THEN 1 ELSE 0 END AS far FROM seen)),
kept AS (
  SELECT ins_code, day AS seen_day, lead(day) OVER (PARTITION BY ins_code ORDER BY day) AS next_day,
         coalesce(last_value(CASE WHEN {ACTIVE.format('')} THEN struct_pack(v := volume, a := value, n := trade_count) END IGNORE NULLS)
           OVER (PARTITION BY ins_code, run ORDER BY day ROWS UNBOUNDED PRECEDING),
           struct_pack(v := volume, a := value, n := trade_count)) AS t
  FROM runs),
reference AS (
  SELECT k.ins_code, r.day, (SELECT max(day) FROM seen s WHERE s.day < r.day) AS ref_day, t.v AS ref_volume, t.a AS ref_value,
         t.n AS ref_trades, k.seen_day
  FROM kept k JOIN rolls r ON r.day > k.seen_day AND (k.next_day IS NULL OR r.day <= k.next_day) AND r.day <= k.seen_day + {P['keep']})"""

ACCEPT = f"""
flagged AS (
  SELECT r.*, r.day AS row_day, se.pre_open, se.open, se.close, f.ref_day,
    {' AND '.join(f'r.{f} IS NOT NULL' for f in _FLOW)} AS eligible, {ACTIVE.format('r.')} AS active,
    coalesce(r.source_time < se.open, false) AS before_open,
    coalesce(f.ref_day < r.day AND (f.ref_volume <> 0 OR f.ref_value <> 0 OR coalesce(f.ref_trades, 0) <> 0)
      AND f.ref_volume = r.volume AND f.ref_value = r.value AND coalesce(f.ref_trades = r.trade_count, true), false) AS repeats
  FROM (SELECT x.*, {day_of('x.source_time')} AS day, (SELECT max(ro.day) FROM rolls ro WHERE ro.roll_seq <= x.seq) AS cur_day FROM real x) r
  LEFT JOIN sess se ON se.class = r.class AND se.day = r.day
  LEFT JOIN reference f ON f.ins_code = r.ins_code AND f.day = r.cur_day),
usable AS (
  SELECT *, CASE WHEN before_open THEN CASE WHEN active THEN 'pre_open' END WHEN repeats THEN 'repeat' END AS carry_kind FROM flagged),
maxed AS (
  SELECT *, CASE WHEN eligible THEN carry_kind END AS carry,
    max(CASE WHEN eligible AND carry_kind IS NULL THEN source_time END)
      OVER (PARTITION BY ins_code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM usable),
base AS (
  SELECT ins_code, seq, source_time, {', '.join(f'{t} AS p_{t}' for t in _T)}, price_last AS p_price, ingest_time AS p_ingest, day AS p_day,
    source_time AS p_time FROM maxed WHERE eligible AND carry IS NULL AND (top IS NULL OR source_time > top)),
acc AS (
  SELECT m.* EXCLUDE (carry_kind), b.* EXCLUDE (ins_code, seq, source_time),
    {', '.join(f'coalesce(m.{t}, 0) - coalesce(b.p_{t}, 0) AS d_{t}' for t in _T)}
  FROM maxed m LEFT JOIN base b ON b.ins_code = m.ins_code AND b.source_time = m.top),
classified AS (
  SELECT *, {WINDOW_START} AS window_start,
    CASE WHEN NOT eligible THEN 'incomplete' WHEN day < p_day THEN 'earlier_day' WHEN carry IS NOT NULL THEN 'carryover'
      WHEN top IS NULL OR day > p_day THEN 'day_baseline' WHEN source_time <= top THEN 'out_of_order'
      WHEN {' OR '.join(f'd_{t} < 0' for t in _T)} THEN 'rebaseline'
      WHEN inst_buy_vol IS NOT NULL AND inst_sell_vol IS NOT NULL AND
        (d_ind_buy_vol + d_inst_buy_vol <> d_volume OR d_ind_sell_vol + d_inst_sell_vol <> d_volume) THEN 'rebaseline'
      ELSE 'interval' END AS outcome,
    {' OR '.join(f'd_{t} < 0' for t in _T)} AS decreased
  FROM acc),
accepted AS (
  SELECT *, outcome = 'day_baseline' AND NOT (NOT active AND (open IS NULL OR before_open)) AS late FROM classified)"""


def _share(v: str) -> str:
    return f"CAST(trunc(CAST(d_value AS DOUBLE) * CAST({v} AS DOUBLE) / CAST(d_volume AS DOUBLE)) AS BIGINT)"


def _band(avg: str) -> str:
    return f"CASE WHEN {avg} >= {P['hot']} THEN 'hot' WHEN {avg} >= {P['plus']} THEN 'hot_plus' ELSE 'retail' END"


SIDES = f"""
sides AS (
  SELECT *, CASE WHEN people > 0 THEN 'attributed' ELSE 'unattributed' END AS attribution, CASE WHEN people > 0 THEN people ELSE 0 END AS participants,
    CASE WHEN people > 0 THEN value // people ELSE 0 END AS avg_ticket,
    CASE WHEN people > 0 THEN {_band('value // people')} END AS band
  FROM (
    SELECT seq, ins_code, symbol, class, day, window_start, price_last, p_time AS interval_from, source_time AS interval_to, d_value // d_volume AS vwap,
      'buy' AS side, 1 AS sign, d_ind_buy_vol AS volume, d_ind_buy_count AS people, {_share('d_ind_buy_vol')} AS value
    FROM accepted WHERE outcome = 'interval' AND d_volume > 0 AND d_ind_buy_vol > 0
    UNION ALL
    SELECT seq, ins_code, symbol, class, day, window_start, price_last, p_time, source_time, d_value // d_volume, 'sell', -1, d_ind_sell_vol,
      d_ind_sell_count, {_share('d_ind_sell_vol')}
    FROM accepted WHERE outcome = 'interval' AND d_volume > 0 AND d_ind_sell_vol > 0)),
nets AS (
  SELECT seq, CAST(sum(CASE WHEN band = 'hot' THEN sign * value ELSE 0 END) AS BIGINT) AS net_hot,
    CAST(sum(CASE WHEN band = 'hot_plus' THEN sign * value ELSE 0 END) AS BIGINT) AS net_hot_plus,
    CAST(sum(CASE WHEN band = 'retail' THEN sign * value ELSE 0 END) AS BIGINT) AS net_retail,
    CAST(sum(CASE WHEN band IS NULL THEN sign * value ELSE 0 END) AS BIGINT) AS net_unattributed
  FROM sides GROUP BY seq),
steps AS (
  SELECT a.seq, a.ins_code, a.symbol, a.class, a.day, a.source_time, a.ingest_time, a.window_start, a.price_last, a.volume, a.open, a.close,
    a.outcome, a.late, a.d_volume, a.d_value, a.p_time, a.p_price, a.p_ingest, a.p_volume,
    coalesce(n.net_hot, 0) AS net_hot, coalesce(n.net_hot_plus, 0) AS net_hot_plus, coalesce(n.net_retail, 0) AS net_retail,
    coalesce(n.net_unattributed, 0) AS net_unattributed
  FROM accepted a LEFT JOIN nets n USING (seq) WHERE a.outcome IN ('day_baseline', 'interval', 'rebaseline'))"""

_RUN = "OVER (PARTITION BY ins_code, day ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY ins_code, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

GAMES = f"""
dayrun AS (
  SELECT *, coalesce(bool_or(late) {_RUN}, false) AS late_day, coalesce(bool_or(outcome = 'rebaseline') {_BEFORE}, false) AS rb_before,
    coalesce(bool_or(outcome = 'rebaseline') {_RUN}, false) AS rb_now,
    {', '.join(f'CAST(sum({n}) {_RUN} AS BIGINT) AS t_{n}' for n in ['net_hot', 'net_hot_plus', 'net_retail', 'net_unattributed'])}
  FROM steps),
daycand AS (
  SELECT *, (outcome = 'interval' AND d_volume > 0) OR (outcome = 'rebaseline' AND (NOT (late_day OR rb_before) OR volume <> 0)) AS cand FROM dayrun),
dayflag AS (
  SELECT *, coalesce(bool_or(cand) {_BEFORE}, false) AS published FROM daycand),
gamerun AS (
  SELECT seq, ins_code, symbol, class, day, source_time AS as_of, volume, t_net_hot AS net_hot, t_net_hot_plus AS net_hot_plus,
    t_net_retail AS net_retail, t_net_unattributed AS net_unattributed, late_day OR rb_now AS partial
  FROM dayflag WHERE (outcome = 'interval' AND d_volume > 0) OR (outcome = 'rebaseline' AND (NOT (late_day OR rb_before)
    OR CASE WHEN published THEN volume <> p_volume ELSE volume <> 0 END))),
games AS (SELECT * FROM gamerun QUALIFY row_number() OVER (PARTITION BY ins_code, day ORDER BY seq DESC) = 1)"""

WINDOWS = f"""
overlap AS (
  SELECT *, outcome = 'interval' AS usable, p_time < window_start AND open IS NOT NULL AND
    greatest(epoch_us(least(ingest_time, close)) - epoch_us(greatest(p_ingest, open)), 0) > {P['gap_after'] * 1_000_000} AS gap
  FROM steps WHERE outcome IN ('interval', 'rebaseline') OR late),
winrun AS (
  SELECT *, CAST(sum(CASE WHEN usable THEN net_hot ELSE 0 END) OVER w AS BIGINT) AS net_so_far,
    first_value(CASE WHEN usable THEN p_price END IGNORE NULLS) OVER w AS price_open,
    first_value(CASE WHEN usable THEN gap END IGNORE NULLS) OVER w AS first_gap, coalesce(bool_or(NOT usable) OVER w, false) AS broken
  FROM overlap WINDOW w AS (PARTITION BY ins_code, day, window_start ORDER BY seq ROWS UNBOUNDED PRECEDING)),
tenrun AS (
  SELECT seq, ins_code, class, day, window_start, net_so_far AS net_hot, price_open, price_last, source_time AS updated_at,
    coalesce(first_gap, false) OR broken AS partial FROM winrun WHERE usable),
ten AS (SELECT * FROM tenrun QUALIFY row_number() OVER (PARTITION BY ins_code, day, window_start ORDER BY seq DESC) = 1)"""

SNAP_BASE = [SNAPS, SESSIONS, REAL]
ENGINE = [*SNAP_BASE, REFERENCE, ACCEPT]
FLOW = [*ENGINE, SIDES]


def with_(parts: list[str], select: str) -> str:
    return f"WITH RECURSIVE {','.join(parts)}\n{select}"


def rehearsed(parts: list[str]) -> list[str]:
    """The same steps over the rehearsed tape."""
    return [REHEARSED if p is SNAPS else p for p in parts]
