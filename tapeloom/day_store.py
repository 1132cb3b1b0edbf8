"""Tables partitioned by day that hold one row per key: a write merges the days it touches.

A write reads the stored partitions of its own days, keeps the newest version of every key and writes those days again by dynamic
partition overwrite. The merged days are first written aside; that folder, once complete, is the write's commit marker: whoever writes
next finishes it if the writer was lost half-way, and an incomplete one is dropped. Readers get the table as it lies, so a condition
on ``day`` prunes partitions and nothing is shuffled. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ASIDE = "_merged-"  # readers of the table pass over names that begin so


class DayStore:
    """``versions`` reduces rows (with their ``day``) to one per key; keys never span days. ``order`` sorts the rows of a day."""

    def __init__(self, spark: SparkSession, path: str, versions: Callable[[DataFrame], DataFrame], order: list[str]):
        self.spark, self.path, self.versions, self.order = spark, path.rstrip("/"), versions, order
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _stored(self, days: list, like: DataFrame) -> DataFrame | None:
        """The rows of ``days`` as they are stored."""
        if not self._files.exists(self._at()) or not any(f.getPath().getName().startswith("day=") for f in self._files.listStatus(self._at())):
            return None
        return self.spark.read.schema(like.schema).parquet(self.path).filter(F.col("day").isin(days))

    def recover(self) -> None:
        """Finish writes that were lost after their commit marker, drop those lost before it."""
        if not self._files.exists(self._at()):
            return
        for status in self._files.listStatus(self._at()):
            name = status.getPath().getName()
            if name.startswith(_ASIDE):
                if self._files.exists(self._at(name, "_SUCCESS")):
                    self._apply(name)
                self._files.delete(self._at(name), True)

    def _apply(self, name: str) -> None:
        merged = self.spark.read.parquet(f"{self.path}/{name}")
        (merged.hint("rebalance", "day").sortWithinPartitions("day", *self.order).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path))

    def write(self, rows: DataFrame, day: Column) -> None:
        """Merge ``rows`` into the days that ``day`` puts them on; days without new rows are not touched."""
        self.recover()
        new = rows.withColumn("day", day)
        days = [r["day"] for r in new.select("day").distinct().collect()]  # the days of one write
        old = self._stored(days, new) if days else None
        merged = self.versions(new if old is None else new.unionByName(old))
        name = _ASIDE + uuid.uuid4().hex
        merged.write.parquet(f"{self.path}/{name}")
        self._apply(name)
        self._files.delete(self._at(name), True)
