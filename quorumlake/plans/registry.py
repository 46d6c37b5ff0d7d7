"""Registered queries: name -> function and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(tables) under a name; tables(t) reads a table of the given folder."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def tables(t: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{t}.parquet")

            tables.spark = spark
            return fn(tables)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return wrap
