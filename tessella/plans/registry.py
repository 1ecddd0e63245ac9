"""Where queries and their oracles meet."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessella.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB must answer on the same tables."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def tuned(spark: SparkSession, sf: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf)

        QUERIES[name] = tuned
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
