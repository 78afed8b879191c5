"""One registered query for each operator: a DataFrame over the fixtures, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Fixtures, with_views
from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``f(fixtures) -> DataFrame`` under an operator's key, with SQL where it has one."""

    def wrap(f: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Fixtures(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_views(sql)
        return f

    return wrap


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in ("flagship", "expressions", "filtering", "joining", "aggregating", "ordering", "graphs", "statistics", "plans", "io", "streams"):
        import_module(f"{__name__}.{name}")
