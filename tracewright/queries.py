"""Registered queries of the library's own operators, each with the SQL that DuckDB runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from tracewright.functions import function_queries, learned_queries  # noqa: F401
    from tracewright.operators import cleanup_queries, compare_queries, contract_queries, document_queries, profile_queries, search_queries, signal_queries, verify_queries  # noqa: F401
    from tracewright.plans import program_queries  # noqa: F401
    from tracewright.sources import source_queries  # noqa: F401
    from tracewright.streaming import stream_queries  # noqa: F401
