"""The market state as a Structured Streaming query: a summary and the changed rows at every trigger.

A trigger runs the batch operators over the stored snapshots of its day and the engine's outputs, and publishes the rows that differ
from its last publication. What the days before hand on is carried over: the first trigger of a day reads each day since the last one it
knows, once, and writes the reference of the day; all further triggers read today alone. The day comes from
the clock (an argument), never from the data, so a late or early message cannot replace the dashboard.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom.functions import tehran
from tapeloom.operators import market, quality
from tapeloom.operators.calendar import DEFAULT_CALENDAR, Calendar
from tapeloom.params import DEFAULT, Params
from tapeloom.runtime import prepare, stage, staged_scope


def latest_day_totals(published: DataFrame) -> DataFrame:
    """Newest day totals per instrument and day: an equal as_of replaces, an older one is ignored."""
    others = [c for c in published.columns if c not in ("ins_code", "day")]
    newest = F.max_by(F.struct(*others), F.struct("as_of", "seq")).alias("n")
    return published.groupBy("ins_code", "day").agg(newest).select("ins_code", "day", "n.*")


class MarketPublisher:
    """``snapshots``, ``day_totals`` and ``issues`` return the stored tables as of now."""

    def __init__(self, spark: SparkSession, path: str, snapshots: Callable[[], DataFrame], day_totals: Callable[[], DataFrame],
                 issues: Callable[[], DataFrame], calendar: Calendar = DEFAULT_CALENDAR, params: Params = DEFAULT):
        self.spark, self.path = prepare(spark), path.rstrip("/")
        self.snapshots, self.day_totals, self.issues = snapshots, day_totals, issues
        self.calendar, self.p = calendar, params

    def _of(self, first: date, last: date) -> DataFrame:
        """Snapshots of the trading days from ``first`` to ``last``; a partition column ``day`` (UTC) prunes what is read."""
        snaps, at = self.snapshots(), F.col("source_time")
        if "day" in snaps.columns:
            snaps = snaps.filter(F.col("day").between(F.lit(first - timedelta(days=1)), F.lit(last))).drop("day")
        return snaps.filter((at >= tehran.day_start(F.lit(first))) & (at < tehran.day_start(F.lit(last + timedelta(days=1)))))

    def _carried(self, name: str) -> tuple[date | None, DataFrame]:
        """The last day with data and what instruments handed on after it, as of the reference folder ``name``."""
        state = self.spark.read.schema(market.REFERENCE_STATE).parquet(f"{self.path}/reference/{name}/state")
        return self.spark.read.schema("day date").parquet(f"{self.path}/reference/{name}/until").first()["day"], state

    def _known(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/reference")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []

    def reference(self, day: date) -> DataFrame:
        """The totals that ``day`` is held against, from the state carried up to it."""
        name = day.isoformat()
        finished = [n for n in self._known() if n <= name and self._finished(n)]
        if name not in finished:
            until, state = self._carried(finished[-1]) if finished else (None, self.spark.createDataFrame([], market.REFERENCE_STATE))
            begin = until + timedelta(days=1) if until else date(1970, 1, 2)
            rows = market.of_day(self._of(begin, day - timedelta(days=1)), self.calendar)
            # The days since the last one known: one, unless the publisher was away.
            for passed in sorted(r["day"] for r in market.latest_snapshots(rows).filter("volume IS NOT NULL AND value IS NOT NULL").select("day").distinct().collect()):
                state = stage(market.carry_reference(state, rows.filter(F.col("day") == F.lit(passed)), passed, until, self.p), "carried")
                until = passed
            state.write.mode("overwrite").parquet(f"{self.path}/reference/{name}/state")
            self.spark.createDataFrame([(until,)], "day date").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/reference/{name}/until")
        until, state = self._carried(name)
        return market.reference_after(state, day, until, self.p)

    def _finished(self, name: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/reference/{name}/until/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def publish(self, day: date, batch: int) -> None:
        """Write rows, changed rows and summary of ``day``."""
        with staged_scope(self.spark):
            ref = stage(self.reference(day), "published-reference")
            rows = market.of_day(self._of(day, day), self.calendar)
            counts = quality.issue_counts(self.issues()).filter(F.col("day") == F.lit(day))
            games = latest_day_totals(self.day_totals().filter(F.col("day") == F.lit(day)))
            table = stage(market.market_table(market.day_states(market.accepted_rows(rows, ref, self.p)), games, counts, self.p), "published-table")
            shown = market.market_rows(table)
            shown.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
            current = self.spark.read.schema(shown.schema).parquet(f"{self.path}/rows/batch={batch}")
            changed = current if batch == 0 else market.changed_rows(
                self.spark.read.schema(shown.schema).parquet(f"{self.path}/rows/batch={batch - 1}"), current, ["ins", "day"])
            changed.write.mode("overwrite").parquet(f"{self.path}/changed/batch={batch}")
            summary = market.market_summary(table, rows, ref.filter(F.col("day") == F.lit(day)), counts, self.calendar)
            summary.write.mode("overwrite").parquet(f"{self.path}/summary/batch={batch}")

    def start(self, ticks: DataFrame, today: Callable[[], date], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Publish at every trigger of ``ticks`` (any stream whose arrival should refresh the market)."""
        writer = ticks.writeStream.foreachBatch(lambda _, n: self.publish(today(), n)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
