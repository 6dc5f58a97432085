"""Registry of named queries: each is (spark, sf_dir) -> DataFrame, optionally with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB oracle (omit for rows-only checks)."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def with_ctes(*ctes: str) -> Callable[[str], str]:
    """Compose DuckDB CTE bodies into one WITH clause in front of a final SELECT."""
    def build(select: str) -> str:
        body = ",\n".join(c for c in ctes if c)
        return f"WITH {body}\n{select}" if body else select
    return build
