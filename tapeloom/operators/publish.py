"""Which polled snapshots are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import tehran
from tapeloom.operators.calendar import DEFAULT_CALENDAR, Calendar
from tapeloom.operators.ordered import Prefix, running
from tapeloom.params import DEFAULT, Params

TIMES = {"seq", "source_time", "ingest_time", "source_time_estimated", "class"}


def market_data_hash(columns: list[str]) -> Column:
    """Hash of everything but the times."""
    return F.xxhash64(*[F.col(c) for c in columns if c not in TIMES])


def publish_filter(snaps: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT) -> DataFrame:
    """Keep the first row of an ingest day or of a new source day, every row inside the instrument's own
    session, and outside it only rows whose market data changed.

    A dropped row equals the kept one before it, so comparing with the previous row is exact.
    """
    rows = snaps.withColumns({
        "ingest_day": tehran.trading_day(F.col("ingest_time")), "source_day": tehran.trading_day(F.col("source_time")),
        "data": market_data_hash(snaps.columns)})
    rows = calendar.with_session(rows, F.col("ingest_day"))
    before = Prefix("before", F.struct("seq", "ingest_day", "source_day", "data"), inclusive=False)
    rows = running(rows, ["ins_code"], [before], p.chunk_rows)
    inside = F.coalesce((F.col("ingest_time") >= F.col("pre_open")) & (F.col("ingest_time") < F.col("close")), F.lit(False))
    keep = (F.col("before").isNull() | (F.col("before.ingest_day") != F.col("ingest_day"))
            | (F.col("before.source_day") != F.col("source_day")) | inside | (F.col("before.data") != F.col("data")))
    return rows.filter(keep).select(*snaps.columns)
