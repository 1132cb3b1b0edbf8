"""On the rehearsed tape every rule of acceptance and of the market state has something to do, at the scale of the SQL comparison."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom.functions import rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    queries = entry.queries()
    return lambda name: queries[f"rehearsed_{name}"](spark, SF)


def values(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_outcomes(run):
    assert values(run("acceptance_outcomes"), "outcome") == {"incomplete", "earlier_day", "carryover", "day_baseline", "out_of_order", "rebaseline", "interval"}
    assert values(run("acceptance_outcomes"), "carry") == {None, "pre_open", "repeat"}
    assert run("issues_out_of_order").filter(F.col("detail").contains("earlier trading day")).count() > 0


def test_states(run):
    assert values(run("ever_traded"), "ever_traded") == {True, False}
    assert values(run("awaiting_reset"), "awaiting") == {True, False}
    assert run("lagging_rows").count() > 0 and run("carried_only_instruments").count() > 0
    assert values(run("row_statuses"), "status") == {"awaiting", "stale", "partial", "incomplete", "unknown", "live"}


def test_aggregates(run):
    flows = run("class_flows").agg(*[F.max(c) for c in ("missing", "lagging", "value_missing", "awaiting")]).first()
    assert all(v > 0 for v in flows), flows
    buckets = ["missing", "untraded", "awaiting", "no_limits", "floor", "down", "flat", "up", "ceil"]
    seen = run("breadth").agg(*[F.max(c) for c in buckets]).first()
    assert all(v > 0 for v in seen), dict(zip(buckets, seen))
    summary = run("market_summary").agg(F.max("awaiting_reset"), F.max("carryover"), F.max("issues")).first()
    assert all(v > 0 for v in summary), summary
    assert values(run("flow_patterns"), "pattern") == {None, *rules.PATTERN_TEXTS}
    assert values(run("flow_patterns"), "pattern_text") == {None, *rules.PATTERN_TEXTS.values()}


def test_anomaly_texts(spark):
    assert values(entry.queries()["anomaly_reasons"](spark, SF), "reason") == set(rules.REASONS.values())
