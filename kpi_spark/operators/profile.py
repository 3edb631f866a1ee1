"""Profiles of tables: one ``agg`` over all columns, unpivoted to one row a column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.functions.typing import detect_types, numeric_columns, text_columns
from kpi_spark.operators.filters import any_null
from kpi_spark.operators.ranking import quantile_table


def per_column(df: DataFrame, columns: Iterable[str], **measures) -> DataFrame:
    """(column, one field a measure), all measures of all columns from one pass.  measures: column -> aggregate."""
    columns = list(columns)
    wide = df.agg(*(F.struct(*(f(c).alias(name) for name, f in measures.items())).alias(f"c{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("m")) for i, c in enumerate(columns)))
    return wide.select(F.explode(rows).alias("r")).select("r.column", "r.m.*")


def nulls(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def null_profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls)."""
    return per_column(df, df.columns, rows=lambda c: F.count(F.lit(1)), nulls=nulls)


def row_profile(df: DataFrame, date: str) -> DataFrame:
    """Rows, rows with any null, first and last day."""
    day = F.col(date).try_cast("date")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_null(df.columns)).alias("rows_with_nulls"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def numeric_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, nulls, min, max, mean)."""
    d = lambda c: F.col(c).cast("double")
    return per_column(df, columns or numeric_columns(df), nulls=nulls, min=lambda c: F.min(d(c)), max=lambda c: F.max(d(c)), mean=lambda c: F.avg(d(c)))


def categorical_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, nulls, approximate distinct values)."""
    return per_column(df, columns or text_columns(df), nulls=nulls, distinct=lambda c: F.approx_count_distinct(c))


def numeric_cards(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, null_pct, min, max, mean, std)."""
    d = lambda c: F.col(c).cast("double")
    share = lambda c: nulls(c) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))
    return per_column(df, columns or numeric_columns(df), null_pct=share, min=lambda c: F.min(d(c)), max=lambda c: F.max(d(c)), mean=lambda c: F.avg(d(c)), std=lambda c: F.stddev_samp(d(c)))


def top_values(df: DataFrame, columns: Iterable[str], k: int = 5) -> DataFrame:
    """(column, value, n, rank): the most frequent values of each column, ties by value."""
    columns = list(columns)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def distinct_values(df: DataFrame, column: str, limit: int = 500) -> tuple[list[str], bool]:
    """The first values in order, without null, and whether there are more than ``limit``."""
    found = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(limit + 1).collect()
    return [r["v"] for r in found[:limit]], len(found) > limit


def sample_profile(df: DataFrame, column: str, rows: int = 1000, examples: int = 20) -> DataFrame:
    """Nulls, distinct values and examples in the first rows."""
    head = df.select(F.col(column).alias("v")).limit(rows)
    return head.agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_distinct("v").alias("distinct"), F.slice(F.array_sort(F.collect_set(F.col("v").cast("string"))), 1, examples).alias("examples")).withColumn("numeric", F.lit(column in numeric_columns(df)))


def date_span(df: DataFrame, column: str) -> DataFrame:
    """First and last day and the days from one to the other."""
    day = F.col(column).try_cast("date")
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn("days", F.datediff("last_day", "first_day") + 1)


def distinct_estimate(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return per_column(df, columns, distinct=lambda c: F.approx_count_distinct(c))


def distinct_sketches(df: DataFrame, columns: Iterable[str], part: Column | None = None, log_size: int = 12) -> DataFrame:
    """(part, column, sketch): a HyperLogLog sketch (of 2 ** log_size places) of each column in each part, one scan for all.

    part: a day, a file (``F.input_file_name()``) or whatever new data has of its own.  A table of sketches is appended to as
    parts arrive; :func:`merged_distinct` reads sketches only, never the old rows.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    long = df.select((F.lit("") if part is None else part).cast("string").alias("part"), cells.alias("c")).select("part", "c.*").where("value is not null")
    return long.groupBy("part", "column").agg(F.hll_sketch_agg("value", F.lit(log_size)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """(by, column, distinct): the estimate over all parts; its standard error is about 0.83 / sqrt(places)."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def describe(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, count, nulls, null_pct, mean, std, min, q1, median, q3, max) of numeric columns, quartiles exact."""
    d = lambda c: F.col(c).cast("double")
    columns = list(columns or numeric_columns(df))
    plain = per_column(
        df,
        columns,
        count=lambda c: F.count(c),
        nulls=nulls,
        null_pct=lambda c: nulls(c) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)),
        mean=lambda c: F.avg(d(c)),
        std=lambda c: F.stddev_samp(d(c)),
        min=lambda c: F.min(d(c)),
        max=lambda c: F.max(d(c)),
    )
    quartiles = quantile_table(df, columns, (0.25, 0.5, 0.75)).select("column", *(F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))))
    joined = plain.join(F.broadcast(quartiles), "column", "left")  # a row a column
    return joined.select("column", "count", "nulls", "null_pct", "mean", "std", "min", "q1", "median", "q3", "max")


def describe_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, count, unique, top, freq); ties of the most frequent value by value."""
    columns = list(columns)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), first.alias("top"), F.max("n").alias("freq"))


def mapping_coverage(mapped: DataFrame, column: str) -> DataFrame:
    """Rows of each mapped value, most first."""
    return mapped.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def column_kinds(df: DataFrame) -> DataFrame:
    """(kind, columns) by semantic type."""
    kinds = df.sparkSession.createDataFrame(list(detect_types(df).items()), "column string, kind string")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("columns"))


def filterable(df: DataFrame, labels: int = 500, numbers: int = 200) -> DataFrame:
    """(column, distinct): dimensions with 2 to ``labels`` values, numbers with at most ``numbers``."""
    numeric = set(numeric_columns(df))
    few = distinct_estimate(df, [*text_columns(df), *numeric])
    return few.where((F.col("distinct") >= 2) & (F.col("distinct") <= F.when(F.col("column").isin(*numeric or [""]), numbers).otherwise(labels)))
