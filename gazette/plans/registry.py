"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gazette.plans.views import Views, duckdb_sql
from gazette.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(views) under name; sql may name derived views and raw tables."""

    def register(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(importable(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = duckdb_sql(sql.strip())
        return f

    return register
