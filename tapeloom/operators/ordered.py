"""Running aggregates over long ordered groups, split so that no task sees a whole hot group.

Rows carry ``seq`` (arrival order, unique per key). ``seq div chunk_rows`` cuts every key into chunks
of at most ``chunk_rows`` rows. A running value is then

    combine(running value inside the chunk, total of the earlier chunks)

Chunk totals come from an ordinary aggregation (combined on the map side) and are tiny; the window that
adds them up and the join that brings them back work on one row per key and chunk. The large side is
shuffled once on (keys, chunk), which serves both the window and the join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Prefix:
    """``value`` aggregated over the rows of the key up to (or, exclusive, before) this row."""

    name: str
    value: Column
    how: str = "max"
    inclusive: bool = True


def chunk_of(seq: Column, chunk_rows: int) -> Column:
    """First possible ``seq`` of the row's chunk."""
    return seq - F.pmod(seq, F.lit(chunk_rows).cast("bigint"))


def combine(how: str, a: Column, b: Column) -> Column:
    if how == "max":
        return F.greatest(a, b)
    if how == "min":
        return F.least(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def carried_in(totals: DataFrame, keys: list[str], prefixes: list[Prefix], chunk: str = "chunk") -> DataFrame:
    """Per key and chunk: each prefix over all earlier chunks. ``totals`` has one row per key and chunk."""
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*keys, chunk, *[_AGG[p.how](p.name).over(earlier).alias(f"_in_{p.name}") for p in prefixes])


def chunk_totals(df: DataFrame, keys: list[str], prefixes: list[Prefix], chunk: str = "chunk") -> DataFrame:
    return df.groupBy(*keys, chunk).agg(*[_AGG[p.how](p.value).alias(p.name) for p in prefixes])


def within_chunk(df: DataFrame, keys: list[str], prefixes: list[Prefix], seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Add every prefix given its carried-in total ``_in_<name>`` (already joined)."""
    base = W.partitionBy(*keys, chunk).orderBy(seq)
    out = df.select(
        "*",
        *[_AGG[p.how](p.value).over(base.rowsBetween(W.unboundedPreceding, 0 if p.inclusive else -1)).alias(f"_own_{p.name}")
          for p in prefixes],
    )
    for p in prefixes:
        out = out.withColumn(p.name, combine(p.how, F.col(f"_own_{p.name}"), F.col(f"_in_{p.name}")))
    return out.drop(*[f"_own_{p.name}" for p in prefixes], *[f"_in_{p.name}" for p in prefixes])


def running(df: DataFrame, keys: list[str], prefixes: list[Prefix], chunk_rows: int, seq: str = "seq") -> DataFrame:
    """``df`` plus one column per prefix. Reads ``df`` twice: stage it first when it is expensive."""
    cut = df.withColumn("chunk", chunk_of(F.col(seq), chunk_rows))
    carry = carried_in(chunk_totals(cut, keys, prefixes), keys, prefixes)
    joined = cut.join(carry, [*keys, "chunk"], "left")
    return within_chunk(joined, keys, prefixes, seq).drop("chunk")
