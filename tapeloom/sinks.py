"""Stored tables and outgoing envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.day_store import DayStore
from tapeloom.functions import tehran
from tapeloom.functions.rules import lookup
from tapeloom.operators.quality import DAY_START_MISSED

# Subject prefix of each output.
SUBJECTS = {"snapshots": "md.snap.", "events": "flow.event.", "day_totals": "flow.game.", "windows": "flow.10m.", "signals": "ai.signal.", "issues": "quality."}


def newest_version(df: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row per key: the newest version. A maximum per group, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), version).alias("n")
    return df.groupBy(*keys).agg(newest).select(*keys, "n.*")


def snapshot_versions(snaps: DataFrame) -> DataFrame:
    """One version per (ins_code, source_time, source): the newest ingest, the last arrival of equal ones."""
    return newest_version(snaps, ["ins_code", "source_time", "source"], F.struct("ingest_time", "seq"))


def window_versions(windows: DataFrame) -> DataFrame:
    """Latest update of every (ins_code, window_start)."""
    return newest_version(windows, ["ins_code", "window_start"], F.struct("updated_at", "seq") if "seq" in windows.columns else F.col("updated_at"))


def issue_versions(issues: DataFrame) -> DataFrame:
    """A repeated DAY_START_MISSED of one instrument and day is stored once (after a restart); others all stay."""
    once = F.col("code") == DAY_START_MISSED
    day = tehran.trading_day(F.col("at"))
    first = (issues.filter(once).groupBy("ins_code", "code", day.alias("_day")).agg(F.min_by(F.struct("seq", "detail", "at"), "seq").alias("f"))
             .select("f.seq", "ins_code", "code", "f.detail", "f.at"))
    return issues.filter(~once).select("seq", "ins_code", "code", "detail", "at").unionByName(first)


def _write(df: DataFrame, path: str, day: Column, order: list[str], mode: str) -> None:
    """Partitioned by day and sorted by instrument, so that readers prune days and skip row groups.

    Rows of a day meet before writing; the adaptive planner splits a day by its size, so a busy one takes as many tasks as it needs.
    """
    out = df.withColumn("day", day)
    (out.hint("rebalance", "day").sortWithinPartitions("day", *order).write.mode(mode).partitionBy("day").parquet(path))


def _with_day(versions: Callable[[DataFrame], DataFrame], at: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: versions(rows.drop("day")).withColumn("day", F.to_date(at))


def snapshot_store(spark: SparkSession, path: str) -> DayStore:
    return DayStore(spark, path, _with_day(snapshot_versions, "source_time"), ["ins_code", "source_time"])


def window_store(spark: SparkSession, path: str) -> DayStore:
    return DayStore(spark, path, _with_day(window_versions, "window_start"), ["ins_code", "window_start"])


def issue_store(spark: SparkSession, path: str) -> DayStore:
    return DayStore(spark, path, lambda rows: _trading_days(issue_versions(rows.drop("day"))), ["code", "at"])


def _trading_days(issues: DataFrame) -> DataFrame:
    """Issues by the trading day on which they were raised: one DAY_START_MISSED of a day never spans two of them."""
    return issues.withColumn("day", tehran.trading_day(F.col("at")))


def write_snapshots(snaps: DataFrame, path: str) -> None:
    """Merge snapshots into the store: one version per (ins_code, source_time, source)."""
    snapshot_store(snaps.sparkSession, path).write(snaps, F.to_date("source_time"))


def write_flow_events(events: DataFrame, path: str, mode: str = "append") -> None:
    _write(events, path, F.to_date("interval_to"), ["ins_code", "interval_to"], mode)


def write_flow_10m(windows: DataFrame, path: str) -> None:
    """Merge window states into the store: the latest update of each window."""
    window_store(windows.sparkSession, path).write(windows, F.to_date("window_start"))


def write_quality(issues: DataFrame, path: str) -> None:
    """Merge issues into the store; a repeated DAY_START_MISSED of an instrument and day is one row."""
    issue_store(issues.sparkSession, path).write(issues, tehran.trading_day(F.col("at")))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots, one version each, with their day."""
    return snapshot_store(spark, path).read()


def read_flow_10m(spark: SparkSession, path: str) -> DataFrame:
    """Stored windows in their latest update."""
    return window_store(spark, path).read()


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Stored issues."""
    return issue_store(spark, path).read()


def envelopes(df: DataFrame, kind: str) -> DataFrame:
    """(subject, value): one JSON message per row, ready for a text or Kafka sink."""
    return df.select(F.concat(F.lit(SUBJECTS[kind]), F.col("ins_code")).alias("subject"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_envelopes(df: DataFrame, kind: str, path: str) -> None:
    """NDJSON recording {"subject", "data"}; readable by the recording source."""
    e = envelopes(df, kind)
    # {"subject":"..."} reopened to take the data
    line = F.concat(F.regexp_replace(F.to_json(F.struct("subject")), r"\}$", ""), F.lit(',"data":'), F.col("value"), F.lit("}"))
    e.select(line.alias("value")).write.mode("append").text(path)


# CSV header and labels of the symbols table.
CSV_HEADER = {"sym": "نماد", "ins": "کد", "class_label": "کلاس", "last": "آخرین (ریال)", "chg": "تغییر (٪)", "value": "ارزش (ریال)",
              "net_hot": "پول درشت (ریال)", "status_label": "وضعیت داده", "src": "زمان منبع"}
CLASS_LABELS = {"stock": "سهام", "equity_etf": "صندوق سهامی", "other_fund": "سایر صندوق‌ها", "fixed_income": "درآمد ثابت", "gold": "طلا",
                "silver": "نقره", "unknown": "نامعلوم"}
STATUS_LABELS = {"awaiting": "در انتظار بازنشانی منبع", "live": "زنده", "stale": "بیات", "partial": "روز ناقص", "incomplete": "داده ناقص",
                 "unknown": "کلاس نامعلوم"}


def csv_rows(rows: DataFrame) -> DataFrame:
    """Symbols table with status (see ``row_status``) as CSV columns; a missing value is NULL, never 0."""
    out = rows.withColumns({
        "status_label": lookup(F.col("status"), STATUS_LABELS), "class_label": lookup(F.col("class"), CLASS_LABELS), "chg": F.when(F.col("chg").isNotNull(), F.format_string("%.2f", "chg")),
        "src": F.date_format("src", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    return out.select(*[F.col(c).cast("string").alias(label) for c, label in CSV_HEADER.items()])


def export_symbols(rows: DataFrame, path: str) -> None:
    csv_rows(rows).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')
