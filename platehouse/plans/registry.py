"""The register of queries and of the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platehouse.plans import fixtures as fx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

def query(sql: str | None = None):
    """Register a function under its name, with SQL where SQL can say it; {ve}, {edges} and {wl} are the fixtures."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.replace("{ve}", fx.VE).replace("{edges}", fx.EDGE_VALUES).replace("{wl}", fx.WL)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
