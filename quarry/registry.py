"""All queries of the library with their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows where there is one."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import quarry.plans  # noqa: F401  registers

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    import quarry.plans  # noqa: F401

    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["page_audit"](spark, sf_dir)
