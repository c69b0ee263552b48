"""Names of this subpackage's queries; kept apart from the library's own registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key``; ``sql`` is what DuckDB runs on the same tables."""

    def add(fn: Query) -> Query:
        if key in LLM_QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        LLM_QUERIES[key] = fn
        if sql is not None:
            LLM_ORACLES[key] = sql
        return fn

    return add
