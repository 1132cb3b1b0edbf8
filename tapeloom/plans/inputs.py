"""Staged inputs of the registered queries, shared within a session while the source files are unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators import flow, quality, signals
from tapeloom.operators.accept import accept
from tapeloom.operators.market import drop_synthetic
from tapeloom.params import Params
from tapeloom.runtime import prepare, stage
from tapeloom.sources import bindings

_staged: dict[tuple, DataFrame] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, length and modification time of the files under ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def shared(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` staged once per session and version of its source tables."""
    files = tuple(fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, sf_dir, name, files)
    if key not in _staged:
        _staged[key] = stage(build(), name)
    return _staged[key]


def plain(df: DataFrame) -> DataFrame:
    """Result form of the registered queries: instants as zone-less UTC timestamps."""
    cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


class Tape:
    """The event stream as a market tape, with its intermediate tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params | None = None):
        self.spark, self.sf_dir = prepare(spark), sf_dir
        self.p = params or bindings.event_params()
        self.calendar = bindings.EVENT_CALENDAR

    def _shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return shared(self.spark, self.sf_dir, f"{name}-{hash(self.p) & 0xFFFFFFFF:x}", ["events"], build)

    @property
    def snapshots(self) -> DataFrame:
        """Every snapshot, synthetic ones included."""
        return self._shared("snapshots", lambda: bindings.snapshots(self.spark, self.sf_dir, self.p, staged=False))

    @property
    def real(self) -> DataFrame:
        return drop_synthetic(self.snapshots)

    @property
    def accepted(self) -> DataFrame:
        return self._shared("accepted", lambda: accept(self.real, self.calendar, self.p))

    @property
    def issues(self) -> DataFrame:
        return quality.issues(self.accepted, self.calendar, self.p)

    @property
    def day_totals(self) -> DataFrame:
        return flow.day_totals(self.accepted, self.p)

    @property
    def signals(self) -> DataFrame:
        return self._shared("signals", lambda: signals.signals(
            flow.intervals(self.accepted), flow.running_10m(self.accepted, self.p), self.calendar, self.p))


class Rehearsed:
    """Mixed into a tape: its snapshots are those of the rehearsal."""

    def _shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return super()._shared(f"rehearsed-{name}", build)

    @property
    def snapshots(self) -> DataFrame:
        return self._shared("snapshots", lambda: bindings.rehearsal(bindings.snapshots(self.spark, self.sf_dir, self.p, staged=False)))
