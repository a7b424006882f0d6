"""Named checks: a Spark query over the bound tables and, where SQL can say the same, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..bindings import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(domain) -> DataFrame`` under ``name``; ``sql`` may refer to the common tables of oracle_tables."""
    def wrap(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Domain(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            from .oracle_tables import with_tables

            ORACLES[name] = with_tables(sql)
        return fn

    return wrap
