"""Registered queries: a Spark callable per name and, where SQL can express it, the statement to check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.plans.inputs import plain

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} registered twice")
        self.queries[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
        if sql is not None:
            self.sql[name] = sql
