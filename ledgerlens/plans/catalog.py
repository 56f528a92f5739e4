"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result is exact, the equivalent DuckDB SQL over the raw test
tables.  ``__spark_entry__`` exposes this registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_sources, q_clean, q_features, q_anomaly, q_stats, q_eval, q_ml, q_retrieval, q_checks  # noqa: F401
