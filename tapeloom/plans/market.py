"""Registered queries over the market state of every trading day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions import rules
from tapeloom.operators import flow, market, quality, series
from tapeloom.plans import market_sql as m
from tapeloom.plans import tape, tape_sql
from tapeloom.plans.inputs import Rehearsed, Tape
from tapeloom.plans.registry import Registry


class Market(Tape):
    """The tape with its market-state tables."""

    @property
    def rows(self) -> DataFrame:
        return market.of_day(self.real, self.calendar)

    @property
    def reference(self) -> DataFrame:
        return self._shared("dashboard-reference", lambda: market.dashboard_reference(self.rows, self.p))

    @property
    def shown(self) -> DataFrame:
        return self._shared("market-rows-accepted", lambda: market.accepted_rows(self.rows, self.reference, self.p))

    @property
    def issue_counts(self) -> DataFrame:
        return quality.issue_counts(self.issues)

    @property
    def table(self) -> DataFrame:
        return self._shared("market-table", lambda: market.market_table(
            market.day_states(self.shown), flow.day_totals(self.accepted, self.p), self.issue_counts, self.p))

    @property
    def market_rows(self) -> DataFrame:
        return market.market_rows(self.table)


ENGINE = [*tape_sql.FLOW, tape_sql.GAMES, tape.ISSUES]
TABLE = [*ENGINE, m.ROWS, m.REFERENCE, m.ACCEPTED, m.TABLE]


class RehearsedMarket(Rehearsed, Market):
    pass


# Queries whose rules the plain tape does not all reach; see ``bindings.rehearsal``.
REHEARSED = ["carried_only_instruments", "ever_traded", "awaiting_reset", "market_rows", "lagging_rows", "class_flows", "flow_patterns", "kpi_values", "breadth",
             "market_summary", "row_statuses", "value_series", "series_bars"]


def register(r: Registry) -> None:
    def add(name: str, build: Callable[[Market], DataFrame], parts: list[str] | None = None, select: str | None = None) -> None:
        r.add(name, lambda spark, sf_dir: build(Market(spark, sf_dir)), tape_sql.with_(parts, select) if select else None)
        if name in REHEARSED:
            r.add(f"rehearsed_{name}", lambda spark, sf_dir: build(RehearsedMarket(spark, sf_dir)), tape_sql.with_(tape_sql.rehearsed(parts), select))

    add("latest_snapshots", lambda t: market.latest_snapshots(t.rows).select(
        "seq", "ins_code", "day", "source_time", "price_last", "volume", "value"), m.BASE,
        "SELECT seq, ins_code, day, source_time, price_last, volume, value FROM latest")
    add("carried_only_instruments", lambda t: market.carried_only(t.rows), m.BASE,
        "SELECT ins_code, day FROM mrows GROUP BY ALL HAVING bool_and(carried)")
    add("dashboard_reference", lambda t: t.reference, [*m.BASE, m.REFERENCE],
        "SELECT ins_code, day, ref_day, ref_volume, ref_value, ref_trades FROM mreference")
    add("market_accepted_rows", lambda t: t.shown.select("seq", "ins_code", "day", "repeats", "counted"), m.STATES,
        "SELECT seq, ins_code, day, repeats, counted FROM maccepted")
    add("ever_traded", lambda t: market.day_states(t.shown).select("ins_code", "day", "ever_traded"), m.STATES,
        "SELECT ins_code, day, ever_traded FROM states")
    add("awaiting_reset", lambda t: market.day_states(t.shown).select("ins_code", "day", "awaiting"), m.STATES,
        "SELECT ins_code, day, awaiting FROM states")
    cols = ["ins", "sym", "class", "day", "last", "value", "net_hot", "hot_as_of", "lagging", "traded", "awaiting_reset", "partial", "src", "ing", "est", "issues"]
    add("market_rows", lambda t: t.market_rows.select(*cols, F.round("chg", 6).alias("chg")), TABLE,
        f"SELECT {', '.join(cols)}, round(chg, 6) AS chg FROM mmarket")
    add("lagging_rows", lambda t: t.market_rows.filter("lagging").select("ins", "day", "hot_as_of", "src"), TABLE,
        "SELECT ins, day, hot_as_of, src FROM mmarket WHERE lagging")
    flows = ["day", "class", "instruments", "missing", "lagging", "value_missing", "awaiting", "net_hot", "net_hot_plus", "net_retail", "net_unattributed",
             "value", "partial", "as_of", "est"]
    add("class_flows", lambda t: market.class_flow(t.table).select(*flows), [*TABLE, m.FLOWS], f"SELECT {', '.join(flows)} FROM flows")
    sign = "CASE WHEN CAST({0} AS DOUBLE) >= 0.01 * CAST(value AS DOUBLE) THEN 1 WHEN CAST(-{0} AS DOUBLE) >= 0.01 * CAST(value AS DOUBLE) THEN -1 ELSE 0 END"
    texts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PATTERN_TEXTS.items())
    add("flow_patterns", lambda t: market.flow_pattern(market.class_flow(t.table), t.p).select("day", "class", "pattern", "pattern_text"),
        [*TABLE, m.FLOWS, f"""
signs AS (SELECT *, {sign.format('net_hot')} AS h, {sign.format('net_retail')} AS r FROM flows),
pats AS (SELECT day, class, CASE WHEN partial OR missing > 0 OR lagging > 0 OR value_missing > 0 OR awaiting > 0 OR net_hot IS NULL THEN NULL
  WHEN coalesce(value, 0) <= 0 THEN 'none' WHEN h < 0 AND r > 0 THEN 'hot_out_retail_in' WHEN h > 0 AND r < 0 THEN 'hot_in_retail_out'
  WHEN h > 0 AND r > 0 THEN 'both_in' WHEN h < 0 AND r < 0 THEN 'both_out' ELSE 'none' END AS pattern FROM signs)"""],
        f"SELECT day, class, pattern, CASE pattern {texts} END AS pattern_text FROM pats")
    card = ("CAST(coalesce(sum(CASE WHEN main THEN {0} END), 0) AS BIGINT) AS {0}, CAST(sum(CASE WHEN NOT main THEN coalesce({0}, 0) END) AS BIGINT) AS secondary_{0}")
    cards = ", ".join(f"('{k}', '{c}', true)" for k, cl in market.KPI_CLASSES.items() for c in cl)
    cards += "".join(f", ('{k}', '{c}', false)" for k, c in market.SECONDARY_CLASS.items())
    add("kpi_values", lambda t: market.kpi_values(t.table), [*TABLE, f"""
cards(kpi, class, main) AS (VALUES {cards}),
perclass AS (
  SELECT day, class, CAST(sum(value) FILTER (NOT awaiting) AS BIGINT) AS value, count(*) AS instruments, count(*) FILTER (NOT awaiting AND value IS NULL) AS missing,
    count(*) FILTER (awaiting) AS awaiting, max(source_time) FILTER (NOT awaiting AND value IS NOT NULL) AS as_of,
    bool_or(NOT awaiting AND value IS NOT NULL AND source_time_estimated) AS est FROM mtable GROUP BY day, class)"""],
        f"""SELECT d.day, k.kpi, CAST(sum(CASE WHEN main THEN value END) AS BIGINT) AS value, {', '.join(card.format(n) for n in ['instruments', 'missing', 'awaiting'])},
  max(CASE WHEN main THEN as_of END) AS as_of, coalesce(bool_or(CASE WHEN main THEN est END), false) AS est,
  max(CASE WHEN NOT main THEN k.class END) AS secondary_class, CAST(sum(CASE WHEN NOT main THEN value END) AS BIGINT) AS secondary_value
FROM (SELECT DISTINCT day FROM mtable) d CROSS JOIN cards k LEFT JOIN perclass p ON p.day = d.day AND p.class = k.class GROUP BY d.day, k.kpi""")
    names = ["missing", "untraded", "awaiting", "no_limits", "floor", "down", "flat", "up", "ceil"]
    add("breadth", lambda t: market.breadth(t.table), [*TABLE, """
placed AS (SELECT *, CASE WHEN awaiting THEN 'awaiting' WHEN NOT coalesce(price_last > 0 AND price_yesterday > 0, false) THEN 'missing'
  WHEN NOT ever_traded THEN 'untraded' WHEN NOT coalesce(price_limit_min > 0 AND price_limit_max > price_limit_min, false) THEN 'no_limits'
  WHEN price_last = price_yesterday THEN 'flat' WHEN price_last > price_yesterday AND price_last >= price_limit_max THEN 'ceil'
  WHEN price_last > price_yesterday THEN 'up' WHEN price_last <= price_limit_min THEN 'floor' ELSE 'down' END AS bucket FROM mtable WHERE class = 'stock')"""],
        f"""SELECT d.day, count(p.day) AS instruments, {', '.join(f"count(*) FILTER (p.bucket = '{n}') AS {n}" for n in names)},
  max(source_time) FILTER (p.bucket IN ('flat', 'ceil', 'up', 'floor', 'down')) AS as_of,
  coalesce(bool_or(p.bucket IN ('flat', 'ceil', 'up', 'floor', 'down') AND source_time_estimated), false) AS est
FROM (SELECT DISTINCT day FROM mtable) d LEFT JOIN placed p USING (day) GROUP BY d.day""")

    def summary(t: Market) -> DataFrame:
        return market.market_summary(t.table, t.rows, t.reference, t.issue_counts, t.calendar)

    add("market_summary", summary, [*TABLE, f"""
carr AS (SELECT day, count(*) AS carryover FROM (SELECT ins_code, day FROM mrows GROUP BY ALL HAVING bool_and(carried)) GROUP BY day),
back AS (SELECT d.day, d.day - CAST(i AS INT) AS past FROM (SELECT DISTINCT day FROM mtable) d, range(1, 22) g(i)),
backsince AS (SELECT b.day, b.past, h.class, max(h.since) AS since FROM back b JOIN (SELECT DISTINCT class, since FROM hours WHERE class <> 'unknown') h ON h.since <= b.past
  WHERE b.past NOT IN ({tape_sql.HOLIDAYS}) GROUP BY ALL),
opened AS (SELECT b.day, max(b.past) AS expected FROM backsince b JOIN hours h ON h.class = b.class AND h.since = b.since AND h.weekday = isodow(b.past) - 1 GROUP BY b.day)"""],
        """SELECT t.day, max(t.source_time) AS as_of, false AS syn, bool_or(t.source_time_estimated) AS est, count(*) AS instruments,
  count(*) FILTER (t.class = 'unknown') AS unknown, count(*) FILTER (t.awaiting) AS awaiting_reset, coalesce(any_value(c.carryover), 0) AS carryover,
  CAST(coalesce((SELECT sum(issues) FROM icounts i WHERE i.day = t.day), 0) AS BIGINT) AS issues,
  any_value(d.ref_day) AS ref_day, any_value(o.expected) AS expected, count(*) FILTER (t.class = 'unknown') / CAST(count(*) AS DOUBLE) AS unknown_share,
  2 * count(*) FILTER (t.class = 'unknown') > count(*) AS unknown_notice, coalesce(any_value(d.ref_day) = any_value(o.expected), false) AS carryover_ok
FROM mtable t LEFT JOIN carr c ON c.day = t.day LEFT JOIN mdays d ON d.day = t.day LEFT JOIN opened o ON o.day = t.day GROUP BY t.day""")

    add("value_series", lambda t: series.value_series(t.shown, t.p).drop("late_until"), [*m.STATES, m.SERIES], "SELECT kpi, day, bar, value, partial FROM series")
    add("series_bars", lambda t: series.series_bars(series.value_series(t.shown, t.p), t.calendar, t.p), [*m.STATES, m.SERIES, m.BARS],
        "SELECT kpi, day, bar, value, partial FROM bars")

    add("map_buckets", lambda t: t.market_rows.select("ins", "day", rules.map_bucket(F.col("chg")).cast("int").alias("bucket")), TABLE,
        "SELECT ins, day, CASE WHEN chg <= -3 THEN 5 WHEN chg <= -1 THEN 4 WHEN chg < 1 THEN 3 WHEN chg < 3 THEN 2 WHEN chg IS NOT NULL THEN 1 END AS bucket FROM mmarket")
    add("market_map", lambda t: market.market_map(t.market_rows, t.p).select("day", "ins", "value", "rank", F.col("bucket").cast("int").alias("bucket"),
                                                                            F.round("share", 9).alias("share")), TABLE,
        """SELECT day, ins, value, CAST(rank AS INT) AS rank, CASE WHEN chg <= -3 THEN 5 WHEN chg <= -1 THEN 4 WHEN chg < 1 THEN 3 WHEN chg < 3 THEN 2 WHEN chg IS NOT NULL THEN 1 END AS bucket,
  round(value / CAST(sum(value) OVER (PARTITION BY day) AS DOUBLE), 9) AS share
FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, ins) AS rank FROM mmarket WHERE value > 0) WHERE rank <= 40""")
    add("rows_without_value", lambda t: market.without_value(t.market_rows), TABLE, "SELECT day, count(*) FILTER (value IS NULL) AS no_value FROM mmarket GROUP BY day")
    for name, column in {"top_by_value": "value", "top_by_net_hot": "net_hot"}.items():
        add(name, lambda t, column=column: market.top_by(t.market_rows.withColumn("ins", F.concat_ws("/", "ins", "day")), column, 50).select("ins", column), TABLE,
            f"SELECT ins || '/' || day AS ins, {column} FROM mmarket ORDER BY {column} DESC NULLS LAST, ins || '/' || day LIMIT 50")
    add("search_symbols", lambda t: market.search_symbols(t.market_rows, " 1 ").select("ins", "sym", "day"), TABLE,
        "SELECT ins, sym, day FROM mmarket WHERE contains(sym, '1') OR contains(ins, '1')")

    def statuses(t: Market) -> DataFrame:
        """Status of each row when the day's last snapshot of the market came in."""
        rows = t.market_rows.withColumn("now", F.max("ing").over(W.partitionBy("day")))
        return market.row_status(rows, t.calendar, t.p).select("ins", "day", "status")

    add("row_statuses", statuses, [*TABLE, "nows AS (SELECT *, max(ing) OVER (PARTITION BY day) AS now FROM mmarket)"],
        f"""SELECT ins, n.day, CASE WHEN awaiting_reset THEN 'awaiting' WHEN lagging OR (EXISTS (SELECT 1 FROM sess se WHERE se.class <> 'unknown'
    AND se.day = {tape_sql.day_of('n.now')} AND (se.class = n.class OR n.class = 'unknown') AND n.now >= se.open AND n.now < se.close)
    AND epoch_us(n.now) - epoch_us(CASE WHEN est THEN ing ELSE src END) > 30000000) THEN 'stale'
  WHEN partial THEN 'partial' WHEN n_missing > 0 OR last IS NULL OR value IS NULL THEN 'incomplete' WHEN n.class = 'unknown' THEN 'unknown' ELSE 'live' END AS status
FROM nows n""")

    def day_changes(t: Market) -> DataFrame:
        """Rows that differ from the instrument's row of the day before it in the data."""
        rows = t.market_rows.select("ins", "day", "class", "traded", "partial", "awaiting_reset")
        shifted = rows.withColumn("day", F.lead("day").over(W.partitionBy("ins").orderBy("day"))).filter(F.col("day").isNotNull())
        return market.changed_rows(shifted, rows, ["ins", "day"])

    add("changed_rows", day_changes, TABLE, """SELECT ins, day, class, traded, partial, awaiting_reset FROM (
  SELECT *, lag(struct_pack(a := class, b := traded, c := partial, d := awaiting_reset)) OVER (PARTITION BY ins ORDER BY day) AS x FROM mmarket)
WHERE x IS NULL OR x.a <> class OR x.b <> traded OR x.c <> partial OR x.d <> awaiting_reset""")

    def p95(t: Market) -> DataFrame:
        received = F.timestamp_micros(F.unix_micros("ingest_time") + (1 + F.col("seq") % 4) * 1_000_000)
        return market.latency_p95(t.snapshots.select("source_time", "ingest_time", "source_time_estimated", received.alias("received")))

    add("latency_p95", p95, [tape_sql.SNAPS], """SELECT window_start, CAST(quantile_disc(ms, 0.95) AS BIGINT) AS p95_ms, count(*) AS n,
  CASE WHEN bool_or(est) THEN 'ingest' ELSE 'source' END AS basis FROM (
  SELECT time_bucket(INTERVAL 5 MINUTE, ingest_time + to_seconds(1 + seq % 4)) AS window_start, source_time_estimated AS est,
    (epoch_us(ingest_time) + (1 + seq % 4) * 1000000 - epoch_us(CASE WHEN source_time_estimated THEN ingest_time ELSE source_time END)) // 1000 AS ms FROM snaps)
GROUP BY window_start""")
    add("signals_without_synthetic", lambda t: market.hide_late_synthetic(flow.flow_events(flow.attribute(flow.side_flows(t.accepted), t.p), t.p), t.snapshots).select(
        "seq", "ins_code", "side"), tape_sql.FLOW, f"""SELECT seq, ins_code, side FROM sides WHERE (band IN ('hot', 'hot_plus') OR (band IS NULL AND value >= {tape_sql.P['hot']}))
  AND ins_code NOT IN (SELECT ins_code FROM snaps WHERE starts_with(source, 'rebase:') OR source = 'synthetic')""")
    add("recent_signals", lambda t: market.recent_signals(t.signals, t.snapshots, t.p).select("ins", "sym", "class", "kind", "at"),
        [*tape_sql.FLOW, tape_sql.WINDOWS, tape.divergence_sql(), tape.radar_sql(), f"""
sigs AS (
  SELECT seq, ins_code, class, kind, "at", '' AS feature FROM divergences
  UNION ALL SELECT seq, ins_code, class, 'anomaly', "at", feature FROM scores
    WHERE scored AND i > {tape_sql.P['warm_up']} AND var > 0 AND abs((value - mean) / sqrt(var)) >= 4.0)"""],
        f"""SELECT s.ins_code AS ins, 'S' || s.ins_code[2:] AS sym, class, kind, "at" FROM sigs s
WHERE {tape_sql.day_of('"at"')} = (SELECT max({tape_sql.day_of('"at"')}) FROM sigs)
  AND ins_code NOT IN (SELECT ins_code FROM snaps WHERE starts_with(source, 'rebase:') OR source = 'synthetic')
ORDER BY seq DESC, kind, feature LIMIT 50""")
