"""Registered queries over the market tape: clock, sessions, acceptance, flow, quality and radar signals."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rules, tehran
from tapeloom.operators import accept as acc
from tapeloom.operators import calendar as cal
from tapeloom.operators import flow, publish, quality, signals
from tapeloom.plans import tape_sql as q
from tapeloom.plans.inputs import Rehearsed, Tape
from tapeloom.plans.registry import Registry
from tapeloom.runtime import shared_dir
from tapeloom.sources import bindings

_LEVELS = ["net_hot", "net_hot_plus", "net_retail", "net_unattributed"]


def _days(t: Tape) -> DataFrame:
    return t.snapshots.select(tehran.trading_day(F.col("source_time")).alias("day")).distinct()


def register(r: Registry) -> None:
    def add(name: str, build: Callable[[Tape], DataFrame], parts: list[str] | None = None, select: str | None = None) -> None:
        r.add(name, lambda spark, sf_dir: build(Tape(spark, sf_dir)), q.with_(parts, select) if select else None)

    class RehearsedTape(Rehearsed, Tape):
        pass

    def again(name: str, build: Callable[[Tape], DataFrame], parts: list[str] | None = None, select: str | None = None) -> None:
        """Queries over outcomes, once more over the tape on which all of them occur."""
        if name in ("acceptance_outcomes", "issues_out_of_order", "issue_counts"):
            r.add(f"rehearsed_{name}", lambda spark, sf_dir: build(RehearsedTape(spark, sf_dir)), q.with_(q.rehearsed(parts), select))

    _acceptance(again)
    _quality(again)
    _clock(add)
    _joins(add, r)
    _acceptance(add)
    _flow(add)
    _quality(add)
    _signals(add)


def _clock(add) -> None:
    def day() -> Column:
        return tehran.trading_day(F.col("source_time"))

    add("trading_clock", lambda t: t.snapshots.select(
        "seq", day().alias("day"), tehran.day_start(day()).alias("day_start"), tehran.floor_10m(F.col("source_time")).alias("floor_10m")),
        q.SNAP_BASE, f"""SELECT seq, {q.day_of('source_time')} AS day, {q.at_second(q.day_of('source_time'), '0')} AS day_start,
  time_bucket(INTERVAL 10 MINUTE, source_time) AS floor_10m FROM snaps""")

    def with_session(t: Tape) -> DataFrame:
        return t.calendar.with_session(t.snapshots, day())

    joined = "FROM snaps s LEFT JOIN sess se ON se.class = s.class AND se.day = " + q.day_of("s.source_time")
    add("window_starts", lambda t: with_session(t).select(
        "seq", tehran.window_start(F.col("open"), F.col("source_time")).alias("window_start")),
        q.SNAP_BASE, f"SELECT seq, {q.FLOORED.format(open='open', ts='source_time')} AS window_start {joined}")
    add("session_flags", lambda t: with_session(t).select(
        "seq", F.coalesce((F.col("source_time") >= F.col("pre_open")) & (F.col("source_time") < F.col("close")), F.lit(False)).alias("in_session"),
        F.coalesce((F.col("source_time") >= F.col("open")) & (F.col("source_time") < F.col("close")), F.lit(False)).alias("is_trading")),
        q.SNAP_BASE, f"""SELECT seq, coalesce(source_time >= pre_open AND source_time < close, false) AS in_session,
  coalesce(source_time >= open AND source_time < close, false) AS is_trading {joined}""")
    add("snapshot_completeness", lambda t: t.snapshots.select(
        "seq", rules.flow_complete().alias("flow_complete"), F.size(rules.missing_flow_fields()).cast("bigint").alias("missing_flow"),
        rules.has_price_limits(F.col("price_limit_min"), F.col("price_limit_max")).alias("has_limits")),
        q.SNAP_BASE, f"""SELECT seq, {' AND '.join(f'{f} IS NOT NULL' for f in q._FLOW)} AS flow_complete,
  CAST({' + '.join(f'CAST({f} IS NULL AS INT)' for f in q._FLOW)} AS BIGINT) AS missing_flow,
  coalesce(price_limit_min > 0 AND price_limit_max >= price_limit_min, false) AS has_limits FROM snaps""")
    add("price_changes", lambda t: t.snapshots.select(
        "seq", F.round(rules.change_pct(F.col("price_last"), F.col("price_yesterday")), 6).alias("chg")),
        q.SNAP_BASE, """SELECT seq, CASE WHEN price_last > 0 AND price_yesterday > 0
  THEN round(CAST(price_last - price_yesterday AS DOUBLE) / price_yesterday * 100, 6) END AS chg FROM snaps""")
    add("trading_activity", lambda t: t.snapshots.select(
        "seq", rules.shows_trading(F.col("volume"), F.col("value"), F.col("trade_count")).alias("shows_trading")),
        q.SNAP_BASE, """SELECT seq, volume IS NULL OR volume > 0 OR coalesce(value, 0) > 0 OR coalesce(trade_count, 0) > 0 AS shows_trading
FROM snaps""")
    add("real_snapshots", lambda t: t.real.select("seq", "ins_code", "source"), [q.SNAPS, q.REAL], "SELECT seq, ins_code, source FROM real")
    def slow_data(t: Tape) -> DataFrame:
        """Polls seen through slowly moving fields only, so that unchanged ones exist."""
        polls = t.snapshots.select("seq", "ins_code", "class", "source_time", "ingest_time", "source", "price_limit_min",
                                   F.expr("ind_sell_count div 8").alias("ind_sell_count"))
        return publish.publish_filter(polls, t.calendar, t.p).select("seq", "ins_code")

    add("market_data_changes", slow_data, q.SNAP_BASE, f"""SELECT seq, ins_code FROM (
  SELECT s.*, {q.day_of('s.ingest_time')} AS iday, {q.day_of('s.source_time')} AS sday, se.pre_open, se.close,
    lag(struct_pack(i := {q.day_of('s.ingest_time')}, s := {q.day_of('s.source_time')}, b := source, f := price_limit_min,
      r := ind_sell_count // 8)) OVER (PARTITION BY ins_code ORDER BY seq) AS x
  FROM snaps s LEFT JOIN sess se ON se.class = s.class AND se.day = {q.day_of('s.ingest_time')})
WHERE x IS NULL OR x.i <> iday OR x.s <> sday OR coalesce(ingest_time >= pre_open AND ingest_time < close, false)
  OR x.b <> source OR x.f IS DISTINCT FROM price_limit_min OR x.r <> ind_sell_count // 8""")


def _joins(add, r: Registry) -> None:
    add("instrument_classes", lambda t: cal.with_class(
        t.snapshots.select("seq", "ins_code"), bindings.instruments(t.spark, t.sf_dir)).select("seq", "ins_code", "class"),
        [q.SNAPS], "SELECT seq, ins_code, class FROM snaps")
    rule_join = f"""rules(class, since, days, pre_s, open_s, close_s, verified) AS (VALUES {q._rule_rows()}),
days AS (SELECT DISTINCT {q.day_of('source_time')} AS day FROM snaps),
names(weekday, name) AS (VALUES (0, 'mon'), (1, 'tue'), (2, 'wed'), (3, 'thu'), (4, 'fri'), (5, 'sat'), (6, 'sun')),
dated AS (
  SELECT d.day, r.*, row_number() OVER (PARTITION BY d.day, r.class ORDER BY r.since DESC) AS age FROM days d JOIN rules r ON r.since <= d.day),
ruled AS (
  SELECT x.class, x.day, {q.at_second('x.day', 'pre_s')} AS pre_open, {q.at_second('x.day', 'open_s')} AS open, {q.at_second('x.day', 'close_s')} AS close,
    x.verified
  FROM dated x JOIN names n ON n.weekday = isodow(x.day) - 1 AND list_contains(x.days, n.name)
  WHERE age = 1 AND x.day NOT IN ({q.HOLIDAYS}))"""
    add("class_sessions", lambda t: cal.sessions(_days(t), t.calendar), [q.SNAPS, rule_join],
        "SELECT class, day, pre_open, open, close, verified FROM ruled")
    def from_file(t: Tape) -> DataFrame:
        """Sessions of the days of the tape by a calendar that went through its file."""
        path = f"{shared_dir(t.spark)}/calendar-{uuid.uuid4().hex}"
        cal.write_calendar(t.spark, t.calendar, path, _days(t).filter("day IS NOT NULL"))
        return cal.sessions(_days(t), cal.load_calendar(t.spark, path).calendar())

    add("loaded_calendar_sessions", from_file, [q.SNAPS, rule_join], "SELECT class, day, pre_open, open, close, verified FROM ruled")
    add("union_sessions", lambda t: cal.union_session(_days(t), t.calendar), [q.SNAPS, rule_join],
        """SELECT 'unknown' AS class, day, min(pre_open) AS pre_open, min(open) AS open, max(close) AS close, bool_and(verified) AS verified
FROM ruled GROUP BY day""")
    add("class_opens", lambda t: t.calendar.opens(_days(t)).withColumn("n_opens", F.size("opens").cast("bigint")).select(
        "day", "n_opens", F.explode_outer("opens").alias("open")), [q.SNAPS, rule_join],
        """SELECT d.day, (SELECT count(DISTINCT open) FROM ruled r WHERE r.day = d.day) AS n_opens, o.open
FROM days d LEFT JOIN (SELECT DISTINCT day, open FROM ruled) o ON o.day = d.day""")
    add("previous_trading_days", lambda t: t.calendar.previous_trading_day(_days(t)), [q.SNAPS, rule_join, f"""
back AS (SELECT d.day, d.day - CAST(i AS INT) AS past FROM days d, range(1, 22) g(i)),
backrules AS (
  SELECT b.day, b.past, r.*, row_number() OVER (PARTITION BY b.day, b.past, r.class ORDER BY r.since DESC) AS age FROM back b JOIN rules r ON r.since <= b.past),
opened AS (
  SELECT x.day, max(x.past) AS expected FROM backrules x JOIN names n ON n.weekday = isodow(x.past) - 1 AND list_contains(x.days, n.name)
  WHERE age = 1 AND x.past NOT IN ({q.HOLIDAYS}) GROUP BY x.day)"""],
        "SELECT d.day, o.expected FROM days d LEFT JOIN opened o USING (day)")

    def both_sessions(t: Tape) -> DataFrame:
        rows = t.calendar.with_session(t.snapshots.select("seq", "class", "source_time", "ingest_time"), tehran.trading_day(F.col("source_time")))
        rows = t.calendar.with_session(rows, tehran.trading_day(F.col("ingest_time")), "in_")
        return rows.select("seq", "pre_open", "open", "close", "in_pre_open", "in_open", "in_close")

    add("snapshot_sessions", both_sessions, q.SNAP_BASE, f"""SELECT seq, a.pre_open, a.open, a.close, b.pre_open AS in_pre_open, b.open AS in_open,
  b.close AS in_close FROM snaps s LEFT JOIN sess a ON a.class = s.class AND a.day = {q.day_of('s.source_time')}
LEFT JOIN sess b ON b.class = s.class AND b.day = {q.day_of('s.ingest_time')}""")


def _acceptance(add) -> None:
    add("day_rolls", lambda t: acc.day_rolls(t.real, t.p).select("day", "roll_seq", "next_seq"), q.ENGINE,
        "SELECT day, roll_seq, next_seq FROM rolls")
    add("prev_day_reference", lambda t: acc.prev_day_reference(t.real, t.p), q.ENGINE,
        "SELECT ins_code, day, ref_day, ref_volume, ref_value, ref_trades, seen_day FROM reference")

    def against_reference(t: Tape) -> DataFrame:
        """Each snapshot beside the instrument's reference of its own day."""
        rows = t.real.select("seq", "ins_code", "volume", "value", "trade_count", tehran.trading_day(F.col("source_time")).alias("day"))
        both = rows.join(acc.prev_day_reference(t.real, t.p), ["ins_code", "day"], "left")
        same = rules.totals_same(*[F.col(c) for c in ["volume", "value", "trade_count", "ref_volume", "ref_value", "ref_trades"]])
        active = rules.totals_active(F.col("volume"), F.col("value"), F.col("trade_count"))
        return both.select("seq", "ins_code", "day", "ref_day", "ref_volume", "ref_value", "ref_trades", active.alias("active"), same.alias("same"))

    add("totals_vs_previous_day", against_reference, q.ENGINE, f"""SELECT r.seq, r.ins_code, r.day, f.ref_day, f.ref_volume, f.ref_value, f.ref_trades,
  {q.ACTIVE.format('r.')} AS active,
  r.volume = f.ref_volume AND r.value = f.ref_value AND coalesce(r.trade_count = f.ref_trades, true) AS same
FROM (SELECT *, {q.day_of('source_time')} AS day FROM real) r LEFT JOIN reference f USING (ins_code, day)""")
    add("acceptance_outcomes", lambda t: t.accepted.select("seq", "ins_code", "day", "outcome", "late", "carry", "ref_day"),
        q.ENGINE, "SELECT seq, ins_code, day, outcome, late, carry, ref_day FROM accepted")
    add("snapshot_pairs", lambda t: t.accepted.filter(F.col("outcome").isin("interval", "rebaseline")).select(
        "seq", "ins_code", "day", F.col("prev.source_time").alias("from_time"), F.col("source_time").alias("to_time"),
        F.col("prev.volume").alias("from_volume"), "volume"), q.ENGINE,
        """SELECT seq, ins_code, day, p_time AS from_time, source_time AS to_time, p_volume AS from_volume, volume FROM accepted
WHERE outcome IN ('interval', 'rebaseline')""")
    add("interval_deltas", lambda t: acc.deltas(t.accepted), q.ENGINE,
        f"""SELECT seq, ins_code, class, day, p_time AS interval_from, source_time AS interval_to, {', '.join(f'd_{t}' for t in q._T)}
FROM accepted WHERE outcome = 'interval'""")
    add("late_rows", lambda t: t.accepted.filter(F.col("outcome").isin("earlier_day", "out_of_order")).select(
        "seq", "ins_code", "outcome", "source_time", F.col("prev.source_time").alias("last_accepted")), q.ENGINE,
        "SELECT seq, ins_code, outcome, source_time, top AS last_accepted FROM accepted WHERE outcome IN ('earlier_day', 'out_of_order')")
    add("future_rows", lambda t: t.real.filter(~acc.not_future(t.p)).select("seq", "ins_code", "source_time", "ingest_time"), q.SNAP_BASE,
        "SELECT seq, ins_code, source_time, ingest_time FROM real WHERE source_time > ingest_time + INTERVAL 1 HOUR")


def _flow(add) -> None:
    def overlap(t: Tape) -> DataFrame:
        seconds = tehran.trading_overlap(F.col("open"), F.col("close"), F.col("prev.ingest_time"), F.col("ingest_time"))
        return t.accepted.filter(flow.is_interval()).select("seq", seconds.alias("seconds_open"))

    add("polling_overlap", overlap, q.ENGINE,
        """SELECT seq, CASE WHEN open IS NULL THEN 0.0 ELSE CAST(greatest(epoch_us(least(ingest_time, close)) - epoch_us(greatest(p_ingest, open)), 0)
  AS DOUBLE) / 1000000.0 END AS seconds_open FROM accepted WHERE outcome = 'interval'""")
    add("interval_vwap", lambda t: flow.interval_vwap(t.accepted), q.ENGINE,
        "SELECT seq, ins_code, day, d_value, d_volume, d_value // d_volume AS vwap FROM accepted WHERE outcome = 'interval' AND d_volume > 0")
    sides = ["seq", "ins_code", "side", "sign", "volume", "value", "vwap"]
    add("side_flows", lambda t: flow.side_flows(t.accepted).withColumn("sign", F.col("sign").cast("int")).select(*sides), q.FLOW,
        "SELECT seq, ins_code, side, CAST(sign AS INT) AS sign, volume, value, vwap FROM sides")
    banded = ["seq", "ins_code", "side", "attribution", "participants", "avg_ticket", "band"]
    add("attributed_flows", lambda t: flow.attribute(flow.side_flows(t.accepted), t.p).select(*banded), q.FLOW,
        f"SELECT {', '.join(banded)} FROM sides")
    events = f"""SELECT seq, ins_code, symbol, class, day, side,
  CASE WHEN attribution = 'attributed' THEN band ELSE 'hot' END AS band, attribution, interval_from, interval_to, volume, value, participants,
  avg_ticket, vwap, price_last
FROM sides WHERE band IN ('hot', 'hot_plus') OR (band IS NULL AND value >= {q.P['hot']})"""

    def flow_events(t: Tape) -> DataFrame:
        return flow.flow_events(flow.attribute(flow.side_flows(t.accepted), t.p), t.p)

    add("flow_events", flow_events, q.FLOW, events)
    add("hot_events", lambda t: flow_events(t).filter(F.col("band") == "hot"), [*q.FLOW, f"events_all AS ({events})"],
        "SELECT * FROM events_all WHERE band = 'hot'")
    add("interval_values", lambda t: flow.intervals(t.accepted).drop("open"), q.ENGINE,
        f"""SELECT seq, ins_code, class, day, p_time AS interval_from, source_time AS interval_to, d_value AS value,
  {q._share('d_ind_buy_vol')} - {q._share('d_ind_sell_vol')} AS net_ind_value, p_price AS price_from, price_last AS price_to
FROM accepted WHERE outcome = 'interval' AND d_volume > 0""")
    games = ["seq", "ins_code", "symbol", "class", "day", "as_of", "volume", *_LEVELS, "partial"]
    add("net_hot_by_day", lambda t: flow.day_totals(t.accepted, t.p).select(*games), [*q.FLOW, q.GAMES], f"SELECT {', '.join(games)} FROM games")
    add("running_day_totals", lambda t: flow.running_day_totals(t.accepted, t.p).select(*games), [*q.FLOW, q.GAMES],
        f"SELECT {', '.join(games)} FROM gamerun")
    ten = ["ins_code", "class", "day", "window_start", "net_hot", "price_open", "price_last", "partial"]
    add("ten_minute_windows", lambda t: flow.ten_minutes(t.accepted, t.p).select(*ten, "updated_at"), [*q.FLOW, q.WINDOWS],
        f"SELECT {', '.join(ten)}, updated_at FROM ten")
    add("running_ten_minute_windows", lambda t: flow.running_10m(t.accepted, t.p).select("seq", *ten), [*q.FLOW, q.WINDOWS],
        f"SELECT seq, {', '.join(ten)} FROM tenrun")


def _issue_sql() -> str:
    clock = "strftime(source_time AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tehran', '%H:%M:%S')"
    opened = "strftime(open AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tehran', '%H:%M')"
    rfc = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
    totals = "'day volume ' || volume || ', value ' || value || ', trades ' || coalesce(trade_count, 0)"
    lag = "CAST(round((epoch_us(source_time) - epoch_us(ingest_time)) / -1000000.0) AS BIGINT)"
    dur = f"CASE WHEN {lag} >= 60 THEN ({lag} // 60) || 'm' || ({lag} % 60) || 's' ELSE {lag} || 's' END"
    decreases = " UNION ALL ".join(
        f"SELECT seq, ins_code, 'CUMULATIVE_DECREASE' AS code, '{'trades' if t == 'trade_count' else t} decreased by ' || (-d_{t}) AS detail, ingest_time AS \"at\", "
        f"CAST(NULL AS DATE) AS once_on FROM accepted WHERE outcome = 'rebaseline' AND d_{t} < 0" for t in q._T)
    missing = " || ".join(f"CASE WHEN {f} IS NULL THEN '{f} ' ELSE '' END" for f in q._FLOW)
    return f"""
occurrences AS (
  SELECT seq, ins_code, 'SOURCE_TIME_ESTIMATED' AS code, 'source provided no timestamp; ingest time used' AS detail, ingest_time AS "at",
    {q.day_of('ingest_time')} AS once_on FROM accepted WHERE source_time_estimated
  UNION ALL SELECT a.seq, a.ins_code, 'STALE', 'lag ' || {dur} || ' > 30s', a.ingest_time, NULL FROM accepted a
    JOIN sess se ON se.class = a.class AND se.day = {q.day_of('a.ingest_time')}
    WHERE NOT a.source_time_estimated AND a.ingest_time >= se.open AND a.ingest_time < se.close AND a.ingest_time - a.source_time > INTERVAL 30 SECOND
  UNION ALL SELECT seq, ins_code, 'INCOMPLETE', 'missing [' || rtrim({missing}) || ']', ingest_time, NULL FROM accepted WHERE NOT eligible
  UNION ALL SELECT seq, ins_code, 'OUT_OF_ORDER', CASE WHEN outcome = 'earlier_day'
      THEN 'source time ' || {rfc.format('source_time')} || ' is on an earlier trading day than ' || {rfc.format('top')}
      ELSE 'source time ' || {rfc.format('source_time')} || ' not after ' || {rfc.format('top')} END, ingest_time, NULL
    FROM accepted WHERE outcome IN ('earlier_day', 'out_of_order')
  UNION ALL SELECT seq, ins_code, 'PREV_DAY_CARRYOVER', CASE WHEN carry = 'pre_open'
      THEN 'pre-open snapshot at ' || {clock} || ' shows ' || {totals} || ' before the ' || class || ' open (' || {opened} || '): previous-day totals, not a baseline'
      ELSE 'snapshot at ' || {clock} || ' repeats the last totals of ' || ref_day || ' (volume ' || volume || ', value ' || value ||
        '): the source has not reset its day totals; not a baseline' END, ingest_time, day FROM accepted WHERE outcome = 'carryover'
  UNION ALL SELECT seq, ins_code, 'DAY_START_MISSED', 'first accepted snapshot of ' || day || ' at ' || {clock} || ' ' || CASE WHEN active
      THEN 'already has ' || {totals} || ': trades before it are not counted'
      ELSE 'was taken after the ' || class || ' session open (' || {opened} || '), so completeness cannot be proven' END
      || '; day totals and this 10-minute window are partial', ingest_time, NULL FROM accepted WHERE late
  UNION ALL {decreases}
  UNION ALL SELECT seq, ins_code, 'SIDE_MISMATCH', 'buy ' || d_ind_buy_vol || '+' || d_inst_buy_vol || ', sell ' || d_ind_sell_vol || '+' ||
      d_inst_sell_vol || ', volume ' || d_volume, ingest_time, NULL FROM accepted WHERE outcome = 'rebaseline' AND NOT decreased),
issues AS (
  SELECT seq, ins_code, code, detail, "at" FROM occurrences WHERE once_on IS NULL
  UNION ALL SELECT seq, ins_code, code, detail, "at" FROM occurrences WHERE once_on IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY ins_code, code, once_on ORDER BY seq) = 1)"""


ISSUES = _issue_sql()


def _quality(add) -> None:
    add("quality_issues", lambda t: t.issues, [*q.ENGINE, ISSUES], "SELECT seq, ins_code, code, detail, \"at\" FROM issues")
    for name, code in {"stale": quality.STALE, "incomplete": quality.INCOMPLETE, "out_of_order": quality.OUT_OF_ORDER,
                       "cumulative_decrease": quality.CUMULATIVE_DECREASE, "side_mismatch": quality.SIDE_MISMATCH,
                       "day_start_missed": quality.DAY_START_MISSED}.items():
        add(f"issues_{name}", lambda t, code=code: quality.all_occurrences(t.accepted, t.calendar, t.p).filter(F.col("code") == code).select(
            "seq", "ins_code", "detail", "at"), [*q.ENGINE, ISSUES], f"SELECT seq, ins_code, detail, \"at\" FROM issues WHERE code = '{code}'")
    for name, code in {"time_estimated": quality.TIME_ESTIMATED, "prev_day_carryover": quality.PREV_DAY_CARRYOVER}.items():
        add(f"issues_{name}", lambda t, code=code: quality.once_per_day(quality.all_occurrences(t.accepted, t.calendar, t.p), [code]),
            [*q.ENGINE, ISSUES], f"SELECT seq, ins_code, code, detail, \"at\" FROM issues WHERE code = '{code}'")
    add("issue_counts", lambda t: quality.issue_counts(t.issues), [*q.ENGINE, ISSUES],
        f"""SELECT ins_code, {q.day_of('"at"')} AS day, count(*) AS issues FROM issues WHERE code <> 'SOURCE_TIME_ESTIMATED' GROUP BY ALL""")


def divergence_sql() -> str:
    from tapeloom.functions.rules import DIVERGENCE_REASONS as texts

    p = q.P
    return f"""
hits AS (
  SELECT *, CASE WHEN net_hot >= {p['divergence_hot']} AND chg <= 0.2 THEN 'absorption' WHEN net_hot <= -{p['divergence_hot']} AND chg >= -0.2 THEN 'support' END AS kind
  FROM (SELECT *, CAST(price_last - price_open AS DOUBLE) / price_open * 100 AS chg FROM tenrun WHERE NOT partial AND price_open > 0)),
divergences AS (
  SELECT seq, ins_code, class, day, kind, CAST(net_hot AS DOUBLE) AS value, window_start AS "at",
    CASE kind WHEN 'absorption' THEN '{texts['absorption']}' ELSE '{texts['support']}' END AS reason
  FROM hits WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ins_code, window_start ORDER BY seq) = 1)"""


def reason_chain() -> str:
    """WHEN parts that choose the text of an anomaly by its feature and the sign of z."""
    signs = {("value_rate", True): "z >= 0", ("value_rate", False): "z < 0", ("net_ind_rate", True): "z > 0", ("net_ind_rate", False): "z <= 0"}
    return " ".join(f"WHEN feature = '{f}' AND {signs[f, up]} THEN '{text}'" for (f, up), text in rules.REASONS.items())


def radar_sql() -> str:
    """The baseline as a row-by-row fold per instrument."""
    p = q.P
    return f"""
ivs AS (
  SELECT seq, ins_code, class, day, open, source_time AS "at", epoch_us(source_time) AS us, (epoch_us(source_time) - epoch_us(p_time)) / 1000000.0 AS secs, d_value AS value,
    {q._share('d_ind_buy_vol')} - {q._share('d_ind_sell_vol')} AS net FROM accepted WHERE outcome = 'interval' AND d_volume > 0),
obs AS (
  SELECT *, row_number() OVER (PARTITION BY ins_code ORDER BY seq) AS i FROM (
    SELECT *, value / secs AS x1, net / secs AS x2, us >= epoch_us(open) + 900000000 AND NOT (class = 'unknown' AND EXISTS (
      SELECT 1 FROM sess se WHERE se.day = ivs.day AND se.class <> 'unknown' AND ivs.us >= epoch_us(se.open) AND ivs.us < epoch_us(se.open) + 900000000)) AS scored
    FROM ivs WHERE secs > 0 AND open IS NOT NULL) WHERE x1 >= 1000000.0),
fold AS (
  SELECT ins_code, i, x1 AS m1, CAST(0 AS DOUBLE) AS v1, x2 AS m2, CAST(0 AS DOUBLE) AS v2 FROM obs WHERE i = 1
  UNION ALL
  SELECT o.ins_code, o.i, f.m1 + 0.02 * (o.x1 - f.m1), 0.98 * (f.v1 + 0.02 * (o.x1 - f.m1) * (o.x1 - f.m1)),
    f.m2 + 0.02 * (o.x2 - f.m2), 0.98 * (f.v2 + 0.02 * (o.x2 - f.m2) * (o.x2 - f.m2))
  FROM fold f JOIN obs o ON o.ins_code = f.ins_code AND o.i = f.i + 1),
scores AS (
  SELECT o.seq, o.ins_code, o.class, o.day, o."at", 'value_rate' AS feature, o.x1 AS value, f.m1 AS mean, f.v1 AS var, o.i, o.scored
  FROM obs o JOIN fold f ON f.ins_code = o.ins_code AND f.i = o.i - 1
  UNION ALL SELECT o.seq, o.ins_code, o.class, o.day, o."at", 'net_ind_rate', o.x2, f.m2, f.v2, o.i, o.scored
  FROM obs o JOIN fold f ON f.ins_code = o.ins_code AND f.i = o.i - 1)"""


def _signals(add) -> None:
    add("divergence_signals", lambda t: signals.divergence(flow.running_10m(t.accepted, t.p), t.p), [*q.FLOW, q.WINDOWS, divergence_sql()],
        "SELECT seq, ins_code, class, day, kind, value, \"at\", reason FROM divergences")

    def baseline(t: Tape) -> DataFrame:
        state = signals.ewma_state(signals.observations(flow.intervals(t.accepted), t.calendar, t.p), t.p)
        return state.filter(F.col("n") > 0).select(
            "seq", "ins_code", "scored", F.round("value_rate_mean", 0).alias("value_mean"), F.round("net_ind_rate_mean", 0).alias("net_mean"),
            F.round(F.sqrt("value_rate_var"), 0).alias("value_sd"), F.round(F.sqrt("net_ind_rate_var"), 0).alias("net_sd"))

    add("radar_baseline", baseline, [*q.ENGINE, radar_sql()],
        """SELECT seq, ins_code, scored, round(max(CASE WHEN feature = 'value_rate' THEN mean END), 0) AS value_mean,
  round(max(CASE WHEN feature = 'net_ind_rate' THEN mean END), 0) AS net_mean, round(max(CASE WHEN feature = 'value_rate' THEN sqrt(var) END), 0) AS value_sd,
  round(max(CASE WHEN feature = 'net_ind_rate' THEN sqrt(var) END), 0) AS net_sd FROM scores GROUP BY ALL""")

    def anomalies(t: Tape) -> DataFrame:
        """A lower bar than the default, so that the short series of the event tables raise signals."""
        hits = signals.anomalies(flow.intervals(t.accepted), t.calendar, bindings.event_params(z_threshold=2.5))
        return hits.select("seq", "ins_code", "feature", "z", F.round("value", 2).alias("value"), F.round("mean", 0).alias("mean"), "at")

    def reasons(t: Tape) -> DataFrame:
        """Texts of the anomalies, with a low bar so that both directions of both features occur."""
        loose = replace(t.p, z_threshold=1.0)
        return signals.anomalies(flow.intervals(t.accepted), t.calendar, loose).select("seq", "ins_code", "feature", "reason")

    add("anomaly_reasons", reasons, [*q.ENGINE, radar_sql()], f"""SELECT seq, ins_code, feature, CASE {reason_chain()} END AS reason FROM (
  SELECT *, (value - mean) / sqrt(var) AS z FROM scores WHERE scored AND i > {q.P['warm_up']} AND var > 0) WHERE abs(z) >= 1.0""")
    add("radar_anomalies", anomalies, [*q.ENGINE, radar_sql()],
        f"""SELECT seq, ins_code, feature, round((value - mean) / sqrt(var), 2) AS z, round(value, 2) AS value, round(mean, 0) AS mean, "at" FROM scores
WHERE scored AND i > {q.P['warm_up']} AND var > 0 AND abs((value - mean) / sqrt(var)) >= 2.5""")
