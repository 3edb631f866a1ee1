"""Order, pages and top rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.functions.typing import date_columns

PAGE = 1000


def dates_first(df: DataFrame) -> DataFrame:
    dates = date_columns(df)
    return df.select(*dates, *(c for c in df.columns if c not in dates))


def by_first_date(df: DataFrame, *ties: str) -> DataFrame:
    """Ordered by the first date column, then by ``ties``."""
    dates = date_columns(df)
    return df.orderBy(F.col(dates[0]).asc_nulls_last(), *ties) if dates else df


def keys(df: DataFrame, order: Iterable[tuple[str, str]]) -> list[Column]:
    """Sort keys (column, asc or desc), nulls last either way."""
    out = []
    for column, way in order:
        if column not in df.columns:
            raise ValueError(f"no such column: {column}")
        out.append(F.col(column).desc_nulls_last() if way.lower() == "desc" else F.col(column).asc_nulls_last())
    return out


def sort(df: DataFrame, order: Iterable[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*keys(df, order))


def page(df: DataFrame, order: Iterable[tuple[str, str]], limit: int = 200, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order."""
    if not 0 < limit <= PAGE:
        raise ValueError(f"a page has 1 to {PAGE} rows")
    return sort(df, order).offset(offset).limit(limit)


def page_of(rows: int, number: int, size: int) -> int:
    """The page number, brought into the range of pages there are."""
    return max(0, min(number, (rows - 1) // size if rows else 0))


@dataclass(frozen=True)
class Preview:
    df: DataFrame
    approximate: bool


def preview(df: DataFrame, build, source: int = 4096, rows: int = 20) -> Preview:
    """``build`` over at most ``source`` filtered rows; approximate if there are more."""
    more = bool(df.select(F.lit(1)).offset(source).limit(1).count())
    return Preview(build(df.limit(source)).limit(rows), more)


def top_per_group(df: DataFrame, group: Iterable[str], score: Column, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows of least score in each group, numbered by ``rank``."""
    window = Window.partitionBy(*group).orderBy(score.asc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def simplest_near_best(df: DataFrame, score: str, simplicity: str, tolerance: float = 0.02) -> DataFrame:
    """The row of least ``simplicity`` rank among those within a tolerance of the best score."""
    best = df.agg(F.min(score).alias("_best"))
    near = df.crossJoin(F.broadcast(best)).where(F.col(score) <= F.col("_best") * (1 + tolerance)).drop("_best")
    return near.orderBy(simplicity).limit(1)
