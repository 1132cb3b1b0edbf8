"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import discard, staged


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the smallest id it can reach.

    Each round sends every vertex to its smallest neighbour and keeps the edges between different targets, which at least
    halves the vertices of a component that are left. Edge lists only meet in joins and partial minima, never in one group.
    """
    left = staged(edges.where("a <> b").distinct(), "edges")
    both = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = staged(both.select("id", F.col("id").alias("component")), "labels")
    while not left.isEmpty():
        ends = left.select("a", "b").union(left.select("b", "a"))
        to = staged(ends.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("to")), "targets")
        goes = lambda key, name: to.select(F.col("a").alias(key), F.col("to").alias(name))
        moved = left.join(goes("a", "x"), "a").join(goes("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
        smaller = staged(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        relabelled = staged(label.join(goes("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        discard(left, label, to)
        left, label = smaller, relabelled
    discard(left)
    return label
