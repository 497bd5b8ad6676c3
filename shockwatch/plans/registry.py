"""Named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .hub import Hub

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(hub) -> DataFrame`` under ``name``; ``sql`` must yield the same rows."""
    def wrap(fn: Callable[[Hub], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Hub(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap
