"""Golden cases of acceptance, flow, windows and quality: one instrument per case, all in one run."""

from __future__ import annotations

from datetime import timedelta

import pytest

from helpers import at, snap, table
from tapeloom.operators import flow, quality
from tapeloom.operators.accept import accept
from tapeloom.operators.calendar import DEFAULT_CALENDAR
from tapeloom.params import DEFAULT, Params
from tapeloom.runtime import stage

T0 = at("2026-09-23", "09:05:00")
SAT, SUN, MON = "2026-09-26", "2026-09-27", "2026-09-28"
B = 1_000_000_000


def s5(n: int = 1):
    return T0 + timedelta(seconds=5 * n)


def first(ins):
    return snap(ins, T0, 10_000, 1_000_000, 600_000, 600_000, 50, 60)


def day_of(ins, cls, day, base, nxt, vol):
    """Day baseline, then 300,000 shares bought by one new buyer."""
    p = vol * 6 // 10
    return [snap(ins, at(day, base), 10_000, vol, p, p, 50, 60, cls),
            snap(ins, at(day, nxt), 10_000, vol + 300_000, p + 300_000, p + 200_000, 51, 60, cls)]


def carry(ins, hms, vol, trades, day=SAT, **over):
    n = 900 if vol > 0 else 0
    return snap(ins, at(day, hms), 10_000, vol, vol * 6 // 10, vol * 6 // 10, n, n, trade_count=trades, **over)


def trade(ins):
    return snap(ins, at(SAT, "09:00:05"), 10_000, 300_000, 300_000, 200_000, 1, 0, trade_count=12)


def repeat(ins, hms, day=SUN, vol=5_000_000, trades=900):
    return snap(ins, at(day, hms), 10_000, vol, 3_000_000, 3_000_000, 900, 900, trade_count=trades)


def full_day(ins):
    return [snap(ins, at(SAT, "08:59:55"), 10_000, 0, 0, 0, 0, 0), repeat(ins, "12:29:55", SAT)]


def glitch(ins, hms, vol, ib, inst_buy):
    return snap(ins, at(SAT, hms), 10_000, vol, ib, 260_000, 6, 5, inst_buy_vol=inst_buy)


CASES = {
    "hot": [first("hot"), snap("hot", s5(), 10_000, 1_300_000, 900_000, 900_000, 51, 160)],
    "plus": [first("plus"), snap("plus", s5(), 10_000, 1_150_000, 750_000, 750_000, 80, 61)],
    "unattributed": [first("unattributed"), snap("unattributed", s5(), 10_000, 1_300_000, 900_000, 900_000, 50, 160)],
    "incomplete": [first("incomplete"), snap("incomplete", s5(), 10_000, 1_300_000, 900_000, 900_000, 51, 160, missing=["ind_buy_count"]),
                   snap("incomplete", s5(2), 10_000, 1_300_000, 900_000, 900_000, 51, 160)],
    "decrease": [first("decrease"), snap("decrease", s5(), 10_000, 900_000, 500_000, 500_000, 50, 60),
                 snap("decrease", s5(2), 10_000, 1_200_000, 800_000, 600_000, 51, 61)],
    "mismatch": [first("mismatch"), snap("mismatch", s5(), 10_000, 1_300_000, 900_000, 900_000, 51, 160, inst_buy_vol=400_010)],
    "order": [first("order"), snap("order", T0, 10_000, 1_300_000, 900_000, 900_000, 51, 160, ingest_time=T0 + timedelta(seconds=3))],
    "earlier": [first("earlier"), snap("earlier", s5(), 10_000, 1_300_000, 900_000, 700_000, 51, 60),
                snap("earlier", T0 - timedelta(days=1), 9_000, 5_000_000, 2_000_000, 2_000_000, 400, 400, ingest_time=T0 + timedelta(seconds=8)),
                snap("earlier", s5(2), 10_000, 1_400_000, 1_000_000, 800_000, 51, 61)],
    "roll": [first("roll"), snap("roll", s5(), 10_100, 1_100_000, 700_000, 700_000, 60, 70, value=11_010_000_000),
             snap("roll", T0 + timedelta(minutes=6), 10_300, 1_200_000, 800_000, 800_000, 70, 80, value=12_040_000_000)],
    "stale": [snap("stale", T0, 10_000, 1_000_000, 600_000, 600_000, 50, 60, ingest_time=T0 + timedelta(minutes=2))],
    "late1": day_of("late1", "stock", SAT, "09:05:00", "09:05:05", 1_000_000), "late2": day_of("late2", "stock", SAT, "08:59:55", "09:00:05", 0),
    "late3": day_of("late3", "stock", SAT, "09:10:00", "09:10:05", 0), "late4": day_of("late4", "gold", SAT, "11:59:55", "12:00:05", 0),
    "late5": day_of("late5", "gold", SAT, "12:05:00", "12:05:05", 1_000_000), "late6": day_of("late6", "gold", SAT, "10:00:00", "12:00:05", 0),
    "rebase": [snap("rebase", at(SAT, "08:59:55"), 10_000, 0, 0, 0, 0, 0), snap("rebase", at(SAT, "09:00:05"), 10_000, 100_000, 60_000, 60_000, 5, 5),
               glitch("rebase", "09:00:10", 400_000, 300_000, 150_000), glitch("rebase", "09:00:12", 450_000, 330_000, 200_000),
               snap("rebase", at(SAT, "09:00:15"), 10_000, 550_000, 380_000, 360_000, 7, 5, inst_buy_vol=250_000)],
    "gap": [snap("gap", at(SAT, "08:59:55"), 10_000, 0, 0, 0, 0, 0), snap("gap", at(SAT, "09:05:05"), 10_000, 100_000, 60_000, 60_000, 5, 5),
            snap("gap", at(SAT, "09:12:00"), 10_000, 400_000, 360_000, 260_000, 6, 8)]
           + [snap("gap", at(SAT, "09:12:05") + timedelta(seconds=5 * i), 10_000, 400_000, 360_000, 260_000, 6, 8) for i in range(96)],
    "estimated": [snap("estimated", at(d, t), 10_000, 0, 0, 0, 0, 0, source_time_estimated=True)
                  for d, t in ((SAT, "09:00:00"), (SAT, "09:00:05"), (SAT, "11:00:00"), (SUN, "09:00:00"))],
    "carry1": [carry("carry1", "08:50:00", 5_000_000, 3000), carry("carry1", "08:55:00", 5_000_000, 3000), carry("carry1", "08:58:00", 0, 0), trade("carry1")],
    "carry2": [carry("carry2", "08:58:00", 0, 0), trade("carry2")],
    "carry3": [carry("carry3", "08:50:00", 5_000_000, 3000), trade("carry3"), snap("carry3", at(SAT, "09:00:10"), 10_000, 600_000, 600_000, 200_000, 2, 0, trade_count=12)],
    "carry4": [carry("carry4", "08:55:00", 0, 7), trade("carry4")], "carry5": [carry("carry5", "08:55:00", 0, 0, value=1), trade("carry5")],
    "post_open": full_day("post_open") + [
        repeat("post_open", "09:00:05"), repeat("post_open", "09:30:00"),
        snap("post_open", at(SUN, "10:30:00"), 10_000, 6_000_000, 3_600_000, 3_000_000, 950, 900, trade_count=1000),
        snap("post_open", at(SUN, "10:30:05"), 10_000, 6_100_000, 3_700_000, 3_000_000, 951, 900, trade_count=1001)],
    "flip": full_day("flip") + [snap("flip", at(SUN, "08:59:55"), 10_000, 0, 0, 0, 0, 0), repeat("flip", "09:00:05"),
                                snap("flip", at(SUN, "09:00:10"), 10_000, 300_000, 300_000, 200_000, 1, 0)],
    "no_count": [snap("no_count", at(SAT, "08:59:55"), 10_000, 0, 0, 0, 0, 0, missing=["trade_count"])],
    "future": [snap("future", at(MON, "10:00:00"), 10_000, 1, 1, 0, 1, 0, "gold", ingest_time=at(SAT, "12:30:00"))],
    "last_seen": full_day("last_seen") + [repeat("last_seen", "12:30:10", SAT, 5_100_000, 910) | {"missing": ["ind_buy_count"], "ind_buy_count": None},
                                          repeat("last_seen", "09:00:05", SUN, 5_100_000, 910)],
    "halted": full_day("halted") + [repeat("halted", "09:30:00", (at(SAT, "00:00:00") + timedelta(days=i)).strftime("%Y-%m-%d")) for i in range(1, 36)],
    "zero_day": full_day("zero_day") + [snap("zero_day", at(SUN, "08:59:55"), 10_000, 0, 0, 0, 0, 0), repeat("zero_day", "09:00:00", MON)],
}


@pytest.fixture(scope="module", params=[DEFAULT.chunk_rows, 25], ids=["whole", "chunks"])
def run(spark, request):
    p = Params(chunk_rows=request.param)
    accepted = stage(accept(table(spark, [r for rows in CASES.values() for r in rows]), DEFAULT_CALENDAR, p), "golden")

    def by_ins(df, order=("seq",)):
        out = {}
        for r in df.orderBy(*order).collect():
            out.setdefault(r.ins_code, []).append(r)
        return out

    return {
        "rows": by_ins(accepted), "events": by_ins(flow.flow_events(flow.attribute(flow.side_flows(accepted), p), p)),
        "games": by_ins(flow.running_day_totals(accepted, p)), "final": by_ins(flow.day_totals(accepted, p), ("day",)),
        "windows": by_ins(flow.running_10m(accepted, p)), "ten": by_ins(flow.ten_minutes(accepted, p), ("window_start",)),
        "issues": by_ins(quality.issues(accepted, DEFAULT_CALENDAR, p))}


def codes(run, ins):
    return [i.code for i in run["issues"].get(ins, [])]


def test_bands(run):
    e = run["events"]["hot"]
    assert [(x.side, x.band, x.attribution, x.participants, x.avg_ticket, x.value) for x in e] == [("buy", "hot", "attributed", 1, 3 * B, 3 * B)]
    g = run["games"]["hot"][0]
    assert (g.net_hot, g.net_retail) == (3 * B, -3 * B) and run["windows"]["hot"][0].net_hot == 3 * B
    sell = [x for x in run["events"]["plus"] if x.side == "sell"][0]
    assert (sell.band, sell.avg_ticket) == ("hot_plus", 1_500_000_000)
    assert (run["games"]["plus"][0].net_hot_plus, run["games"]["plus"][0].volume) == (-1_500_000_000, 1_150_000)
    u = run["events"]["unattributed"]
    assert [(x.attribution, x.avg_ticket) for x in u] == [("unattributed", 0)]
    g = run["games"]["unattributed"][0]
    assert (g.net_hot, g.net_unattributed) == (0, 3 * B) and run["windows"]["unattributed"][0].net_hot == 0


def test_acceptance(run):
    assert "INCOMPLETE" in codes(run, "incomplete")
    assert [x.interval_from for x in run["events"]["incomplete"]] == [T0.astimezone().replace(tzinfo=None)]
    assert "CUMULATIVE_DECREASE" in codes(run, "decrease") and run["events"]["decrease"][0].volume == 300_000
    assert "SIDE_MISMATCH" in codes(run, "mismatch") and "mismatch" not in run["events"]
    assert "OUT_OF_ORDER" in codes(run, "order") and "order" not in run["events"]
    assert "OUT_OF_ORDER" in codes(run, "earlier")
    g = run["games"]["earlier"][-1]
    assert (str(g.day), g.net_hot, g.net_hot_plus) == ("2026-09-23", 3 * B, -1 * B)
    assert "STALE" in codes(run, "stale")


def test_windows_roll(run):
    w = run["windows"]["roll"]
    assert w[0].window_start != w[1].window_start and (w[1].price_open, w[1].price_last) == (10_100, 10_300)


@pytest.mark.parametrize("ins, partial, window", [("late1", True, True), ("late2", False, False), ("late3", True, True), ("late4", False, False),
                                                  ("late5", True, True), ("late6", False, False)])
def test_late_start(run, ins, partial, window):
    g, w = run["games"][ins][0], run["windows"][ins][0]
    assert (g.net_hot, g.partial, w.partial, "DAY_START_MISSED" in codes(run, ins)) == (3 * B, partial, window, partial)


def test_rebaseline_marks_partial(run):
    g = run["games"]["rebase"]
    assert [(x.volume, x.partial) for x in g] == [(100_000, False), (400_000, True), (450_000, True), (550_000, True)]
    assert run["final"]["rebase"][0].volume == 550_000
    assert [w.partial for w in run["windows"]["rebase"]] == [False, True]


def test_polling_gap_marks_the_landing_window(run):
    flags = [(w.window_start.minute, w.partial) for w in run["ten"]["gap"]]
    # windows of 09:00 (nothing seen for five minutes after the open), 09:10 and 09:20 Tehran
    assert [p for _, p in flags] == [True, True, False] and not run["final"]["gap"][0].partial


def test_once_per_day(run):
    assert codes(run, "estimated").count("SOURCE_TIME_ESTIMATED") == 2


def test_pre_open_carryover(run):
    assert codes(run, "carry1").count("PREV_DAY_CARRYOVER") == 1 and "DAY_START_MISSED" not in codes(run, "carry1")
    assert (run["games"]["carry1"][0].net_hot, run["games"]["carry1"][0].partial) == (3 * B, False)
    assert "PREV_DAY_CARRYOVER" not in codes(run, "carry2") and not run["games"]["carry2"][0].partial
    assert codes(run, "carry3") == ["PREV_DAY_CARRYOVER", "DAY_START_MISSED"] and run["games"]["carry3"][0].partial
    for ins in ("carry4", "carry5"):
        assert codes(run, ins) == ["PREV_DAY_CARRYOVER", "DAY_START_MISSED"]


def test_repeated_totals(run):
    sunday = [r.outcome for r in run["rows"]["post_open"] if str(r.day) == SUN]
    assert sunday == ["carryover", "carryover", "day_baseline", "interval"]
    assert codes(run, "post_open").count("PREV_DAY_CARRYOVER") == 1
    g = run["games"]["post_open"][-1]
    assert g.partial and g.net_hot + g.net_hot_plus + g.net_retail + g.net_unattributed == 1 * B
    g = run["games"]["flip"][-1]
    assert (str(g.day), g.partial, g.net_hot) == (SUN, False, 3 * B) and "PREV_DAY_CARRYOVER" in codes(run, "flip")
    assert codes(run, "no_count") == []
    assert run["rows"]["last_seen"][-1].outcome == "carryover" and run["rows"]["zero_day"][-1].outcome == "carryover"
    assert [r.outcome for r in run["rows"]["halted"][2:]] == ["carryover"] * 35


def test_day_totals_equal_the_last_published_state(run):
    last = {(g.ins_code, g.day): g for rows in run["games"].values() for g in rows}
    for rows in run["final"].values():
        for f in rows:
            g = last.pop((f.ins_code, f.day))
            assert all(f[c] == g[c] for c in ("as_of", "volume", "net_hot", "net_hot_plus", "net_retail", "net_unattributed", "partial"))
    assert not last
