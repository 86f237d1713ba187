"""The registry of named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query under a name, with the SQL that gives the same rows (None where SQL cannot)."""

    def add(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    from lakewright.plans import aggregates, dashboards, documents, intake, joins, links, matching, outlines, scans, search, sheets, states, timeline, windows, workbooks, workspace  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["f6_hybrid_search"](spark, sf_dir)
