"""Cases at the bounds: fast-fading baselines, recordings whose names need escaping, versions over several writes, exact tails."""

from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom import sinks
from tapeloom.operators import classmap, eod_labels, signals
from tapeloom.operators.eod import EodParams
from tapeloom.params import Params
from tapeloom.sources import recordings
from tests.helpers import at, snap, table, upper_tail


@pytest.mark.parametrize("alpha", [0.03, 0.6, 0.95])
def test_baseline_over_all_alphas(spark, alpha):
    rng = random.Random(8)
    xs = [rng.uniform(50, 150) for _ in range(1500)]
    rows = spark.createDataFrame([("a", i, x, -x) for i, x in enumerate(xs)], "ins_code string, seq long, value_rate double, net_ind_rate double")
    got = {r["seq"]: r for r in signals.ewma_state(rows, Params(alpha=alpha)).collect()}
    mean, var = xs[0], 0.0
    for i in range(1, len(xs)):
        assert got[i]["value_rate_mean"] == pytest.approx(mean, rel=1e-9)
        assert got[i]["net_ind_rate_mean"] == pytest.approx(-mean, rel=1e-9)
        assert got[i]["value_rate_var"] == pytest.approx(var, rel=1e-6, abs=1e-6)
        off = xs[i] - mean
        mean, var = mean + alpha * off, (1 - alpha) * (var + alpha * off * off)


def test_recordings_with_spaces_in_their_names(spark, tmp_path):
    for name in ("day one.ndjson", "day two.ndjson"):
        (tmp_path / name).write_text(f'{{"file":"{name}","no":0}}\n{{"file":"{name}","no":1}}\n')
    rows = recordings.read_recording(spark, str(tmp_path)).orderBy("seq").collect()
    assert len({r["seq"] for r in rows}) == 4
    assert [("one" in r["payload"], '"no":0' in r["payload"]) for r in rows] == [(True, True), (True, False), (False, True), (False, False)]


def test_versions_merge_over_two_writes(spark, tmp_path):
    when = at("2024-01-02", "10:00:00")
    first = table(spark, [snap("a", when, 100, 10, 5, 5, 1, 1), snap("b", when, 100, 10, 5, 5, 1, 1)])
    newer = table(spark, [snap("a", when, 101, 10, 5, 5, 1, 1, ingest_time=when + timedelta(seconds=9))])
    path = str(tmp_path / "snapshots")
    sinks.write_snapshots(first, path)
    sinks.write_snapshots(newer, path)
    assert {(r["ins_code"], r["price_last"]) for r in sinks.read_snapshots(spark, path).collect()} == {("a", 101), ("b", 100)}


def test_student_tail(spark):
    # Closed forms: one degree of freedom is Cauchy, two is algebraic, many are close to normal.
    cases = [(t, n) for t in (-3.0, -0.5, 0.0, 0.7, 2.5) for n in (1, 2, 3, 4, 7, 2_000)]
    rows = spark.createDataFrame(cases + [(1.0, 0), (None, 5)], "t double, n long")
    got = {(r["t"], r["n"]): r["p"] for r in rows.withColumn("p", eod_labels.one_sided_p(F.col("t"), F.col("n"))).collect()}
    for t in (-3.0, -0.5, 0.0, 0.7, 2.5):
        assert got[t, 1] == pytest.approx(0.5 - math.atan(t) / math.pi, abs=1e-12)
        assert got[t, 2] == pytest.approx(0.5 - t / (2 * math.sqrt(2 + t * t)), abs=1e-12)
        assert got[t, 2_000] == pytest.approx(0.5 * math.erfc(t / math.sqrt(2)), abs=1e-3)
        for n in (1, 2, 3, 4, 7, 2_000):
            assert got[t, n] == pytest.approx(upper_tail(t, n), abs=1e-11)
        for n in (3, 4, 7):  # numerical integral of the density
            c = math.gamma((n + 1) / 2) / (math.sqrt(n * math.pi) * math.gamma(n / 2))
            steps = 4000
            xs = [t * k / steps for k in range(steps + 1)]
            ys = [c * (1 + x * x / n) ** (-(n + 1) / 2) for x in xs]
            half = t / steps / 3 * sum(y * (1 if k in (0, steps) else 4 if k % 2 else 2) for k, y in enumerate(ys))
            assert got[t, n] == pytest.approx(0.5 - half, abs=1e-9)
    assert got[1.0, 0] is None and got[None, 5] is None


def test_student_tail_keeps_small_values(spark):
    """The tail is summed, not left over from 1: closed forms and the scalar fraction, to nine digits at any size."""
    cases = [(t, n) for t in (2.1, 3.0, 6.0, 9.5, 40.0, 1e4) for n in (1, 2, 3, 4, 9, 30, 250, 5_000, 200_000)]
    rows = spark.createDataFrame(cases, "t double, n long")
    got = {(r["t"], r["n"]): r["p"] for r in rows.withColumn("p", eod_labels.one_sided_p(F.col("t"), F.col("n"))).collect()}
    smallest = 1.0
    for t, n in cases:
        want = math.atan(1 / t) / math.pi if n == 1 else 1 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t)) if n == 2 else upper_tail(t, n)
        if want > 1e-300:
            assert got[t, n] == pytest.approx(want, rel=1e-9), (t, n)
            smallest = min(smallest, want)
        else:
            assert got[t, n] <= 1e-290
    assert smallest < 1e-100
    assert got[9.5, 5_000] < 1e-20


def test_scoreboard_window_crosses_chunks(spark):
    """The rolling window is the same however a trial is cut; one day may close more signals than the window holds."""
    import random

    rng = random.Random(4)
    rows = [(t, f"I{k}", k, rng.choice([1, 2, 3, 50, 51, 90, rng.randint(0, 400)]), rng.gauss(0, 1)) for t in ("a", "b") for k in range(150)]
    closed = spark.createDataFrame(rows, "trial string, ins string, no long, exit_no long, r_multiple double")
    backtest = closed.groupBy("trial").agg(F.avg("r_multiple").alias("mean"), F.stddev_samp("r_multiple").alias("sd"))

    def board(days):
        return {(r.trial, r.ins): (r.n, round(r.live_mean, 9), r.status) for r in eod_labels.scoreboard(closed, backtest, EodParams(scoreboard=30), days).collect()}

    want = {}
    for t in ("a", "b"):
        own = sorted([r for r in rows if r[0] == t], key=lambda r: (r[3], r[1], r[2]))
        for k, r in enumerate(own):
            last = [x[4] for x in own[max(0, k - 29):k + 1]]
            want[t, r[1]] = (len(last), round(sum(last) / len(last), 9))
    for days in (1, 7, 1000):
        assert {k: v[:2] for k, v in board(days).items()} == want


def test_smallest_of_a_large_group(spark):
    rows = spark.range(10_000).select(F.lit("g").alias("k"), F.col("id").alias("x"))
    got = classmap.smallest_per_group(rows, ["k"], F.col("x"), 3)
    assert sorted(r["item"] for r in got.collect()) == [0, 1, 2]
