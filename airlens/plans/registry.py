"""Where queries and their oracle statements are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, changed: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the table expressions of ``oracle``, some of them ``changed``."""
    from airlens.plans.oracle import with_ctes
    from airlens.session import prepare

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, changed)
        return fn

    return add
