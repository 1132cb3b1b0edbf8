"""Session-level helpers: time zone, staged tables, shipped code."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """All instants are UTC; every time rule converts to Tehran explicitly. Of repeated keys of a JSON object the last counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, removed when the application ends.

    It lies in the folder named by ``spark.checkpoint.dir``, or in the warehouse where that is unset: both are shared by the
    driver and all executors.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where several passes need the same intermediate rows: the table is columnar, so each pass
    reads only its columns, and it outlives lost executors. Its size on disk is known to the planner,
    which broadcasts it in a join only below spark.sql.autoBroadcastJoinThreshold.

    The shuffle files of the write go when it ends: the table is all that is read from then on, and the next one would
    otherwise find them still on disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application; call before functions of it run there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # The application's own folder on the driver; addPyFile sends the archive to every executor.
    archive = os.path.join(sc._temp_dir, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_scopes: list[list[str]] = []


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the tables staged inside the block when it ends (a micro-batch has written its results by then).

    Yields the list of their paths, in order: one that is taken out of it stays until the application ends.
    """
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
