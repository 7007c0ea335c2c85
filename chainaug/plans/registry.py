"""Query registry: name -> (Spark plan builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        @functools.wraps(fn)
        def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package
            from ..sources.fixtures import query_scope

            ship_package(spark)
            with query_scope():
                return fn(spark, sf_dir)

        QUERIES[name] = scoped
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco
