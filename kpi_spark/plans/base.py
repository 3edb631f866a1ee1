"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, table), where ``table(name)`` opens one of the tables and ``table.path(name)`` says where it is."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{name}.parquet")

            table.path = lambda name: f"{sf_dir}/{name}.parquet"
            return f(spark, table)

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Some columns as doubles of so many decimals, so that the order of a sum doesn't show."""
    return df.withColumns({c: two(F.col(c), digits) for c in columns})


def two(column: Column, digits: int = 2) -> Column:
    return F.round(column.cast("double"), digits)
