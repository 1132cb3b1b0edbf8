"""The streaming engine yields what the batch job yields, also across restarts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import rules
from tapeloom.operators import flow, market, quality, signals
from tapeloom.operators.accept import accept
from tapeloom.runtime import stage
from tapeloom.sources import bindings
from tapeloom.streaming.engine import Engine, dedup_messages

P = bindings.event_params(z_threshold=2.0, warm_up=5)
CAL = bindings.EVENT_CALENDAR


def rows(df, digits=4):
    def norm(v):
        return round(v, digits) if isinstance(v, float) else v

    cols = sorted(df.columns)
    return sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def snaps(spark, sf_dir):
    return bindings.snapshots(spark, sf_dir)


@pytest.fixture(scope="module")
def expected(snaps):
    real = snaps.filter(~rules.is_synthetic(F.col("source"), F.col("ins_code"), F.col("symbol")))
    a = stage(accept(real, CAL, P), "expected")
    return {
        "issues": quality.issues(a, CAL, P), "flow_events": flow.flow_events(flow.attribute(flow.side_flows(a), P), P),
        "day_totals": flow.running_day_totals(a, P), "windows": flow.running_10m(a, P),
        "signals": signals.signals(flow.intervals(a), flow.running_10m(a, P), CAL, P)}


def test_stream_equals_batch(spark, snaps, expected, tmp_path):
    """Three files, one per trigger, both queries stopped and restarted in between; some messages come twice, and instruments
    that turn out synthetic show nothing, not even what came before. State is written for the instruments of a trigger alone."""
    source = tmp_path / "in"
    cuts = [0, 330, 700, 10_000]
    schema = snaps.schema
    written = []
    for i in range(3):
        seq = F.col("seq")
        part = snaps.filter(((seq >= cuts[i]) & (seq < cuts[i + 1])) | ((seq < cuts[i]) & (seq % 50 == 7)))
        part = part if i < 2 else part.filter(seq >= 700).unionByName(part.filter((seq < 700) & (seq % 100 == 7)))
        part.coalesce(1).write.mode("append").parquet(str(source))
        engine = Engine(spark, str(tmp_path / "engine"), CAL, P)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        for query in (lambda: engine.start_clock(stream, str(tmp_path / "clock"), {"availableNow": True}),
                      lambda: engine.start(str(tmp_path / "checkpoint"), {"availableNow": True})):
            running = query()
            running.awaitTermination()
            assert running.exception() is None
        states = [o for p in running.recentProgress for o in p.stateOperators if p.numInputRows]
        written += [o.numRowsUpdated for o in states]
    for name, want in expected.items():
        got = engine.output(name)
        assert rows(got.select(*want.columns)) == rows(market.hide_late_synthetic(want, snaps)), name
    assert max(written) <= 6 * snaps.select("ins_code").distinct().count()


def test_state_is_written_for_changed_instruments(spark, snaps, tmp_path):
    """A trigger with rows of one instrument updates the state of that one, however many there are."""
    engine = Engine(spark, str(tmp_path / "engine"), CAL, P)
    one = snaps.agg(F.min("ins_code")).first()[0]
    counts = []
    for part in (snaps.filter("seq < 400"), snaps.filter((F.col("seq") >= 400) & (F.col("ins_code") == one))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        engine.start_clock(stream, str(tmp_path / "clock"), {"availableNow": True}, dedup=False).awaitTermination()
        running = engine.start(str(tmp_path / "checkpoint"), {"availableNow": True})
        running.awaitTermination()
        counts.append([(o.numRowsTotal, o.numRowsUpdated) for o in running.recentProgress[0].stateOperators])
    for (total, _), (_, updated) in zip(*counts):
        # its held row, day, window, baseline, and a report for each of its days
        assert total > 20 and 0 < updated < total / 4


def test_duplicate_messages_are_stored_once(spark, snaps, tmp_path):
    source = tmp_path / "in"
    snaps.coalesce(1).write.parquet(str(source))
    snaps.coalesce(1).write.mode("append").parquet(str(source))
    stream = dedup_messages(spark.readStream.schema(snaps.schema).parquet(str(source)))
    query = (stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    keys = ["ins_code", "source_time", "ingest_time"]
    assert spark.table("deduped").count() == snaps.select(*keys).distinct().count()


def test_market_publication(spark, snaps, expected, tmp_path):
    """A second publication without new data changes nothing; with more data it publishes what differs."""
    from datetime import date

    from tapeloom.operators import market
    from tapeloom.streaming.market import MarketPublisher

    day = date(2024, 1, 8)
    real = stage(snaps.filter(~rules.is_synthetic(F.col("source"), F.col("ins_code"), F.col("symbol"))), "real")
    totals, issues = stage(expected["day_totals"], "totals"), stage(expected["issues"], "issues")
    seen = {"limit": 10_000_000}
    cut = real.filter(F.to_date("source_time") == F.lit(day)).agg(F.expr("percentile(seq, 0.5)")).first()[0]
    pub = MarketPublisher(spark, str(tmp_path), lambda: real.filter(F.col("seq") <= seen["limit"]), lambda: totals.filter(F.col("seq") <= seen["limit"]),
                          lambda: issues.filter(F.col("seq") <= seen["limit"]), CAL, P)
    seen["limit"] = cut
    pub.publish(day, 0)
    seen["limit"] = 10_000_000
    pub.publish(day, 1)
    pub.publish(day, 2)

    def read(name, n):
        return spark.read.parquet(f"{tmp_path}/{name}/batch={n}")

    assert read("changed", 0).count() == read("rows", 0).count() > 0
    assert 0 < read("changed", 1).count() <= read("rows", 1).count()
    assert read("changed", 2).count() == 0
    whole = market.of_day(real, CAL)
    table = market.market_table(market.day_states(market.accepted_rows(whole, market.dashboard_reference(whole, P), P)),
                                flow.day_totals(stage(accept(real, CAL, P), "again"), P), quality.issue_counts(issues), P)
    assert rows(market.market_rows(table).filter(F.col("day") == F.lit(day))) == rows(read("rows", 2))
    assert read("summary", 2).first().instruments == read("rows", 2).count()


def test_reference_is_carried_over(spark, snaps, tmp_path):
    """Day by day, and after days away, the carried reference equals the one computed over all history; a day is read once."""
    from datetime import timedelta

    from tapeloom import sinks
    from tapeloom.streaming.market import MarketPublisher

    real = stage(snaps.filter(~rules.is_synthetic(F.col("source"), F.col("ins_code"), F.col("symbol"))), "real")
    sinks.write_snapshots(real, str(tmp_path / "store"))
    history = market.of_day(real, CAL)
    want = market.dashboard_reference(history, P)
    days = sorted(r["day"] for r in history.select("day").distinct().collect())
    for name, chosen in (("daily", days[:6] + [days[6] + timedelta(days=1)]), ("away", [days[1], days[9], days[10]])):
        pub = MarketPublisher(spark, str(tmp_path / name), lambda: sinks.read_snapshots(spark, str(tmp_path / "store")), None, None, CAL, P)
        for day in chosen:
            got = pub.reference(day)
            if day in days:
                assert rows(got) == rows(want.filter(F.col("day") == F.lit(day)).select(*got.columns)), (name, day)
    plan = pub._of(days[10], days[10])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
