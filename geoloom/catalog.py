"""The registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its oracle where SQL can express it."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from geoloom.plans import audits, books, cells, registered, shapes  # noqa: F401  register on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from geoloom.plans import audits, books, cells, registered, shapes  # noqa: F401

    return dict(_ORACLES)
