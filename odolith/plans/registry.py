"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odolith.plans.bindings import Bound, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Bound under its name, with its SQL."""

    def add(f: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Bound(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
