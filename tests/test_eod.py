"""End-of-day features: no look-ahead, hand-checked values and the statistics."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import eod, signals
from tapeloom.operators import eod_labels as lab
from tapeloom.params import Params
from tapeloom.runtime import stage
from tapeloom.sources import bindings
from tests.helpers import upper_tail

P = eod.EodParams(**bindings.BAR_PARAMS)


def chain(bars):
    f = eod.flow_features(eod.price_features(eod.adjust_prices(bars, P), P), P)
    f = eod.universe(eod.trend_features(eod.reaction_features(f, P), P), P)
    fam = eod.families(eod.normalized(f, P), P)
    return eod.vetoes(eod.setups(eod.excess_and_class(fam, eod.equal_weight_index(f), P), P), P)


def test_no_look_ahead(spark, sf_dir):
    """Features of a day do not change when later bars are cut off."""
    bars = stage(eod.numbered(bindings.bars(spark, sf_dir)), "bars")
    cut = bars.agg(F.expr("percentile(no, 0.6)")).first()[0]
    cols = ["ins", "no", "mdv20", "f1", "f3_run", "rvol", "ad", "rs", "gate", "atr14", "in_universe", "mic_class", "setup", "trigger", "m3", "near_miss"]
    whole, part = chain(bars).filter(F.col("no") <= cut).select(*cols), chain(bars.filter(F.col("no") <= cut)).select(*cols)

    def key(df):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)

    assert key(whole) == key(part)


def series(spark, values):
    rows = [("A", i + 1, 0, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ins string, no long, seg int, idx int, x double")


def test_wilder_matches_the_recursion(spark):
    """Also across blocks: with n = 2 a block is 299 rows long."""
    values = np.random.default_rng(1).normal(100, 10, 1000)
    got = [r.w for r in eod.wilder(series(spark, values), "x", "w", 2).orderBy("no").collect()]
    want, s = [None], values[:2].mean()
    want.append(s)
    for v in values[2:]:
        s = s + (v - s) / 2
        want.append(s)
    assert got[0] is None and np.allclose(got[1:], want[1:], rtol=1e-12)


def test_percentile_uses_average_ranks(spark):
    df = spark.createDataFrame([(1, v) for v in (10.0, 20.0, 20.0, 30.0, None)], "day int, v double").withColumn("p", eod.percentile("v", ["day"]))
    assert [r.p for r in df.orderBy("v").collect()] == [None, 0.0, 50.0, 50.0, 100.0]


def test_adjustment_review_breaks_the_series(spark):
    d = date(2026, 1, 3)
    rows = [("A", d + timedelta(days=i), i + 1, pc, py) for i, (pc, py) in enumerate([(100, 100), (110, 100), (60, 55), (61, 60), (200, 122)])]
    bars = spark.createDataFrame(rows, "ins string, day date, no long, pc long, py long")
    for c in ("pl", "pmax", "pmin", "pf"):
        bars = bars.withColumn(c, F.col("pc"))
    got = eod.adjust_prices(bars.withColumn("tvol", F.lit(10))).orderBy("no").collect()
    assert [(r.f, r.review, r.seg) for r in got] == [(1.0, False, 0), (1.0, False, 0), (0.5, False, 0), (1.0, False, 0), (1.0, True, 1)]
    assert math.isclose(got[2].adj_close / got[1].adj_close - 1, 60 / 55 - 1)


@pytest.mark.parametrize("opened, low, high, lock, base, careful", [
    (100, 95, 105, None, 100, 100), (105, 95, 106, None, 101, 101), (105, 102, 106, None, None, None), (100, 95, 100, None, 100, 101),
    (110, 110, 110, "up", None, None), (90, 90, 90, "down", 90, 90), (99, 99, 99, "flat", None, None)])
def test_fills(spark, opened, low, high, lock, base, careful):
    schema = "ins string, no long, pf long, pl long, pc long, py long, pmin long, pmax long, lock string, g double, seg int"
    bars = spark.createDataFrame([("A", 1, 99, 99, 99, 99, 98, 100, None, 1.0, 0), ("A", 2, opened, 99, 99, 99, low, high, lock, 1.0, 0)], schema)
    orders = spark.createDataFrame([("t", "A", 1, 101, 90, 95.0)], "trial string, ins string, no long, cap long, stop long, level double")
    r = lab.fills(orders, bars).first()
    assert (r.fill_base, r.fill_conservative) == (base, careful)


def test_student_tail():
    """Known quantiles of Student's t."""
    for t, dof, p in ((1.812, 10, 0.05), (2.764, 10, 0.01), (6.314, 1, 0.05), (1.645, 1_000_000, 0.05), (0.0, 7, 0.5), (-1.812, 10, 0.95)):
        assert abs(upper_tail(t, dof) - p) < 2e-4


def test_newey_west_and_fdr(spark):
    x = np.random.default_rng(3).normal(0.5, 1, 60)
    df = spark.createDataFrame([("t", "A", i, 3, float(v)) for i, v in enumerate(x)] + [("n", "A", i, 3, float(v - 0.5)) for i, v in enumerate(x)],
                               "trial string, ins string, no long, h int, excess double")
    p = eod.EodParams(min_events=30)
    got = {r.trial: r for r in lab.benjamini_hochberg(lab.newey_west(df, p), p).collect()}
    e = x - x.mean()
    var = sum((1 if j == 0 else 2 * (1 - j / 3)) * (e[j:] * e[:len(e) - j]).sum() / len(x) for j in range(3))
    assert math.isclose(got["t"].t, x.mean() / math.sqrt(var / len(x)), rel_tol=1e-9)
    assert got["t"].passes and not got["n"].passes and got["t"].p_adjusted == pytest.approx(min(1, got["t"].p * 2))


@pytest.mark.parametrize("block, chunk", [(None, 1 << 20), (1500, 40)])
def test_radar_baseline_matches_the_recursion(spark, block, chunk):
    """Exponentially weighted mean and variance, against the row-by-row rule; also over several blocks."""
    rng = np.random.default_rng(5)
    n = 4000
    x1, x2 = rng.normal(1e7, 1e6, n), rng.normal(0, 1e6, n)
    df = spark.createDataFrame([("A", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x1, x2))], "ins_code string, seq long, value_rate double, net_ind_rate double")
    p = Params(chunk_rows=chunk)
    got = signals.ewma_state(df, p, block).orderBy("seq").collect()
    for name, x in (("value_rate", x1), ("net_ind_rate", x2)):
        m, v = x[0], 0.0
        for i in range(1, n):
            assert math.isclose(got[i][f"{name}_mean"], m, rel_tol=1e-8, abs_tol=1e-3)
            assert math.isclose(got[i][f"{name}_var"], v, rel_tol=1e-6, abs_tol=1.0)
            d = x[i] - m
            m, v = m + 0.02 * d, 0.98 * (v + 0.02 * d * d)
