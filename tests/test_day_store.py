"""The day store: one row per key over several writes, pruned reads without a shuffle, and writes lost half-way."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom import sinks
from tapeloom.day_store import DayStore

COLUMNS = "seq long, ins_code string, source string, source_time timestamp, ingest_time timestamp, price_last long"


def snaps(spark, *rows):
    """(seq, instrument, day of January, ingest second, price)"""
    return spark.createDataFrame([(s, i, "feed", datetime(2024, 1, d, 8, 0), datetime(2024, 1, d, 8, 1, at), p) for s, i, d, at, p in rows], COLUMNS)


def shown(df):
    return sorted((r.ins_code, r.day.day, r.price_last) for r in df.collect())


def test_writes_merge_by_day(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_snapshots(snaps(spark, (1, "a", 1, 0, 10), (2, "b", 1, 0, 20), (3, "a", 2, 0, 30)), path)
    untouched = sorted(p.name for p in (tmp_path / "t" / "day=2024-01-02").iterdir())
    # another writer: a newer version, an older one that must lose, and a new key; only the first of January is written again
    sinks.write_snapshots(snaps(spark, (7, "a", 1, 5, 11), (0, "b", 1, 0, 19), (8, "c", 1, 0, 40)), path)
    got = sinks.read_snapshots(spark, path)
    assert shown(got) == [("a", 1, 11), ("a", 2, 30), ("b", 1, 20), ("c", 1, 40)]
    assert sorted(p.name for p in (tmp_path / "t" / "day=2024-01-02").iterdir()) == untouched
    plan = got.filter("day = DATE'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "Exchange" not in plan
    sinks.write_snapshots(snaps(spark).limit(0), path)
    assert got.count() == 4


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_snapshots(snaps(spark, (1, "a", 1, 0, 10)).limit(0), path)
    sinks.write_snapshots(snaps(spark, (1, "a", 1, 0, 10)), path)
    assert shown(sinks.read_snapshots(spark, path)) == [("a", 1, 10)]


@pytest.mark.parametrize("after_marker", [True, False])
def test_lost_writers(spark, tmp_path, monkeypatch, after_marker):
    """A write lost after its commit marker is finished by the next one; one lost before it leaves no trace."""
    path = str(tmp_path / "t")
    sinks.write_snapshots(snaps(spark, (1, "a", 1, 0, 10)), path)

    def lost(self, name):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(DayStore, "_apply", lost)
        with pytest.raises(RuntimeError):
            sinks.write_snapshots(snaps(spark, (2, "a", 1, 9, 12)), path)
    assert shown(sinks.read_snapshots(spark, path)) == [("a", 1, 10)]
    if not after_marker:
        for aside in (tmp_path / "t").glob("_merged-*"):
            (aside / "_SUCCESS").unlink()
    sinks.write_snapshots(snaps(spark, (3, "b", 2, 0, 50)), path)
    assert shown(sinks.read_snapshots(spark, path)) == [("a", 1, 12 if after_marker else 10), ("b", 2, 50)]
    assert not list((tmp_path / "t").glob("_merged-*"))


def test_windows_and_issues(spark, tmp_path):
    windows = spark.createDataFrame([("a", datetime(2024, 1, 1, 8, 0), datetime(2024, 1, 1, 8, m), m) for m in (1, 3, 2)],
                                    "ins_code string, window_start timestamp, updated_at timestamp, net_hot long")
    for part in (windows.filter("net_hot < 3"), windows.filter("net_hot = 3"), windows.filter("net_hot = 1")):
        sinks.write_flow_10m(part, str(tmp_path / "w"))
    assert [r.net_hot for r in sinks.read_flow_10m(spark, str(tmp_path / "w")).collect()] == [3]
    issue = "seq long, ins_code string, code string, detail string, at timestamp"
    at = datetime(2024, 1, 1, 8, 0)
    for seq in (2, 1):
        sinks.write_quality(spark.createDataFrame([(seq, "a", "DAY_START_MISSED", "x", at), (seq, "a", "STALE", "y", at)], issue), str(tmp_path / "i"))
    got = sinks.read_quality(spark, str(tmp_path / "i"))
    assert sorted((r.code, r.seq) for r in got.collect()) == [("DAY_START_MISSED", 1), ("STALE", 1), ("STALE", 2)]
    assert got.filter(F.col("day") == F.lit("2024-01-01").cast("date")).count() == 3
