"""Golden cases of the value series, the market rows and the aggregates."""

from __future__ import annotations

from datetime import timedelta

import pytest

from helpers import at, snap, table
from tapeloom.functions import rules
from tapeloom.operators import market, series
from tapeloom.operators.calendar import DEFAULT_CALENDAR
from tapeloom.params import Params
from tapeloom.runtime import stage
from pyspark.sql import functions as F

# one trading day per case: Saturdays to Wednesdays of three weeks
DAYS = [f"2026-10-{d:02d}" for d in (3, 4, 5, 6, 7, 10, 11, 12, 13, 14)]


def quote(case: int, hms: str, volume: int, value: int, **over):
    return snap(f"S{case}", at(DAYS[case], hms), 1, volume, 0, 0, 0, 0, value=value, price_yesterday=1, **over)


def feed(case: int, start: str, end: str, step: int, value: int, by: int, volume: int):
    out, t = [], at(DAYS[case], start)
    while t <= at(DAYS[case], end):
        out.append(snap(f"S{case}", t, 1, volume, 0, 0, 0, 0, value=value, price_yesterday=1))
        t, value = t + timedelta(seconds=step), value + by
    return out


CASES = [
    [quote(0, "08:50:00", 0, 0), quote(0, "09:01:00", 1, 100), quote(0, "09:09:59", 1, 250), quote(0, "09:10:00", 1, 400)],
    [quote(1, "09:21:00", 1, 5_000), quote(1, "09:29:50", 1, 5_010), quote(1, "09:30:10", 1, 5_020)],
    [quote(2, "08:59:00", 0, 0), quote(2, "09:15:00", 1, 1_000), quote(2, "09:15:10", 1, 10), quote(2, "09:25:00", 1, 1_010)],
    [quote(3, "09:00:30", 0, 0), quote(3, "09:01:00", 1, 100), quote(3, "09:45:00", 1, 9_100), quote(3, "09:45:05", 1, 9_200)],
    [quote(4, "09:00:05", 5_000_000, 50_000_000_000)] + feed(4, "09:00:10", "09:19:50", 20, 1_000_000, 1_000_000, 100),
    [quote(5, "09:10:00", 1, 1_000), quote(5, "09:10:05", 1, 900), quote(5, "09:10:10", 1, 1_100)],
    [quote(6, "08:59:00", 0, 0), quote(6, "09:09:50", 1, 1_000), quote(6, "09:09:55", 1, 900), quote(6, "09:10:05", 1, 1_100)],
    [quote(7, "08:59:00", 0, 0), quote(7, "09:09:50", 1, 1_000), quote(7, "09:09:55", 1, 900), quote(7, "09:10:05", 1, 950), quote(7, "09:10:25", 1, 1_000)],
    feed(8, "12:10:00", "12:29:50", 10, 1_000, 10, 1) + [quote(8, "12:45:00", 200, 1_000 + 120 * 10 + 5)],
]


@pytest.fixture(scope="module", params=[1 << 20, 7], ids=["whole", "chunks"])
def bars(spark, request):
    p = Params(chunk_rows=request.param)
    rows = market.of_day(table(spark, [r for c in CASES for r in c]), DEFAULT_CALENDAR)
    accepted = market.accepted_rows(rows, market.dashboard_reference(rows, p), p)
    out = {}
    for r in series.series_bars(series.value_series(accepted, p), DEFAULT_CALENDAR, p).collect():
        local = (r.bar + timedelta(hours=3, minutes=30)).strftime("%H:%M")
        out.setdefault(str(r.day), {})[local] = (r.value, r.partial)
    return [out.get(d) for d in DAYS[:len(CASES)]]


def test_value_series(bars):
    assert bars[0] == {"08:50": (0, False), "09:00": (250, False), "09:10": (150, False)}
    assert bars[1] == {"09:00": (None, True), "09:10": (None, True), "09:20": (10, True), "09:30": (10, False)}
    assert bars[2] == {"08:50": (0, False), "09:00": (None, True), "09:10": (1_000, True), "09:20": (10, True)}
    assert bars[3] == {"09:00": (100, True), "09:10": (None, True), "09:20": (None, True), "09:30": (None, True), "09:40": (9_100, True)}
    assert bars[4]["09:00"][1] and bars[4]["09:10"] == (30_000_000, False)
    assert bars[5]["09:10"] == (100, True)
    assert bars[6]["09:10"] == (100, True)
    assert bars[7]["09:10"] == (50, True)
    assert not bars[8]["12:20"][1]


def test_reset_wait(spark):
    """Yesterday's totals after the open wait for a reset; an incomplete row does not end the wait."""
    rows = [quote(0, "12:00:00", 10, 100, trade_count=5), snap("S0", at(DAYS[1], "09:10:00"), 1, 10, 0, 0, 0, 0, value=100, trade_count=5),
            snap("S0", at(DAYS[1], "09:11:00"), 1, 11, 0, 0, 0, 0, missing=["value"]), snap("S1", at(DAYS[1], "08:50:00"), 1, 10, 0, 0, 0, 0),
            snap("S2", at(DAYS[1], "09:10:00"), 1, 0, 0, 0, 0, 0, value=0)]
    day = market.of_day(table(spark, rows), DEFAULT_CALENDAR)
    ref = stage(market.dashboard_reference(day), "ref")
    assert [(r.ins_code, str(r.day), str(r.ref_day), r.ref_volume) for r in ref.collect()] == [("S0", DAYS[1], DAYS[0], 10)]
    states = {(r.ins_code, str(r.day)): r for r in market.day_states(market.accepted_rows(day, ref)).collect()}
    assert states["S0", DAYS[1]].awaiting and not states["S0", DAYS[1]].ever_traded
    assert not states["S2", DAYS[1]].awaiting and not states["S2", DAYS[1]].ever_traded
    assert [(r.ins_code, str(r.day)) for r in market.carried_only(day).collect()] == [("S1", DAYS[1])]


TABLE = ("ins_code string, day date, class string, awaiting boolean, ever_traded boolean, price_last long, price_yesterday long, price_limit_min long, "
         "price_limit_max long, value long, source_time timestamp, source_time_estimated boolean, lagging boolean, "
         "game struct<net_hot: long, net_hot_plus: long, net_retail: long, net_unattributed: long, partial: boolean, as_of: timestamp>")


def row(ins, cls="stock", last=100, y=100, lo=95, hi=105, traded=True, value=1_000, game=None, awaiting=False, lagging=False):
    now = at(DAYS[0], "10:00:00")
    if game is not None:
        game = (*game, now)
    return (ins, now.date(), cls, awaiting, traded, last, y, lo, hi, value, now, False, lagging, game)


def test_breadth(spark):
    rows = [row("a", last=None), row("b", y=0), row("c", traded=False), row("d", lo=None, hi=None), row("e", lo=95, hi=95), row("f", last=95), row("g", last=94),
            row("h", last=99), row("i"), row("j", last=101), row("k", last=105), row("l", last=106), row("m", last=110, hi=110), row("n", cls="gold"), row("o", awaiting=True)]
    b = market.breadth(spark.createDataFrame(rows, TABLE)).first()
    assert (b.instruments, b.missing, b.untraded, b.no_limits, b.floor, b.down, b.flat, b.up, b.ceil, b.awaiting) == (14, 2, 1, 2, 2, 1, 1, 1, 3, 1)


def test_class_flow_counts_what_is_missing(spark):
    g = (-4_000_000_000, 300, 2_500_000_000, 5, False)
    part = (0, 0, 0, 0, True)
    rows = [row("a", game=g, value=10_000_000_000), row("b"), row("c", traded=False, value=0), row("d", cls="gold", game=g, value=10_000_000_000),
            row("e", cls="silver", game=part), row("u", cls="unknown", game=g)]
    flows = {r["class"]: r for r in market.flow_pattern(market.class_flow(spark.createDataFrame(rows, TABLE))).collect()}
    s = flows["stock"]
    assert (s.net_hot, s.net_hot_plus, s.net_retail, s.net_unattributed, s.missing, s.instruments) == (-4_000_000_000, 300, 2_500_000_000, 5, 1, 3)
    assert s.pattern is None and flows["gold"].pattern == "hot_out_retail_in" and flows["silver"].pattern is None
    assert flows["fixed_income"].net_hot is None and flows["fixed_income"].instruments == 0 and len(flows) == 6


@pytest.mark.parametrize("hot, retail, value, rule", [
    (-10, 10, 1000, "hot_out_retail_in"), (10, -10, 1000, "hot_in_retail_out"), (10, 10, 1000, "both_in"), (-10, -10, 1000, "both_out"),
    (9, -10, 1000, "none"), (10, -9, 1000, "none"), (10, -10, None, "none"), (10, -10, 0, "none")])
def test_flow_pattern(spark, hot, retail, value, rule):
    flows = spark.createDataFrame([(hot, retail, value, False, 0, 0, 0, 0)], "net_hot long, net_retail long, value long, partial boolean, missing long, lagging long, "
                                  "value_missing long, awaiting long")
    assert market.flow_pattern(flows).first().pattern == rule


def test_kpi_values(spark):
    rows = [row("a", value=7_000), row("b", value=None), row("c", cls="gold", value=40), row("d", cls="silver", value=2), row("e", cls="equity_etf", value=300),
            row("f", cls="fixed_income", value=None), row("g", value=99, awaiting=True)]
    k = {r.kpi: r for r in market.kpi_values(spark.createDataFrame(rows, TABLE)).collect()}
    assert (k["value_stock"].value, k["value_stock"].missing, k["value_stock"].awaiting, k["value_stock"].secondary_value) == (7_000, 1, 1, 300)
    assert k["value_metals"].value == 42 and k["value_fixed"].value is None


def test_latency_and_lists(spark):
    samples = [(at(DAYS[0], "10:00:00"), at(DAYS[0], "10:00:01"), False, at(DAYS[0], "10:00:00") + timedelta(milliseconds=ms)) for ms in range(100, 2100, 100)]
    df = spark.createDataFrame(samples, "source_time timestamp, ingest_time timestamp, source_time_estimated boolean, received timestamp")
    r = market.latency_p95(df).first()
    assert (r.p95_ms, r.n, r.basis) == (1900, 20, "source")
    rows = spark.createDataFrame([("b", 1), ("a", None), ("c", 3), ("d", 1)], "ins string, value long")
    assert [x.ins for x in market.top_by(rows, "value", 10).collect()] == ["c", "b", "d", "a"]
    chg = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.99, 1.0, 3.0, None)], "chg double").select(rules.map_bucket(F.col("chg")).alias("b"))
    assert [x.b for x in chg.collect()] == [5, 4, 3, 2, 1, None]
