"""Named queries over the given tables, each with the SQL it has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is DuckDB SQL with the same rows and columns."""

    def add(function: Query) -> Query:
        _queries[name] = function
        if sql is not None:
            _oracles[name] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    from varve import plans  # noqa: F401  registers on import

    return _queries


def oracles() -> dict[str, str]:
    from varve import plans  # noqa: F401

    return _oracles


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)
