"""Ranks and exact quantiles of columns of any length, of several columns and groups at once.

Equal values are counted first, with partial counts on the map side, in one scan for all
columns.  The distinct values are cut into ranges of (group, column, value), counted up within
each range, and moved by the totals of the group's ranges before.  There are as many ranges as the session has
shuffle partitions, and a large group spans many; the ranged counts are written once, so
that all steps see the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpi_spark.sources.scratch import scratch_path


def _is_number(column: Column, kind: T.DataType) -> Column:
    some = column.isNotNull()
    return some & ~F.isnan(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else some


def _counted_up(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``counts`` (keys, value, n) with ``before``, the rows of the key's smaller values, and ``total``, all of them."""
    spark = counts.sparkSession
    path = scratch_path(spark, "ranged")
    counts.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    earlier = Window.unboundedPreceding, -1
    sizes = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("_size"))  # a row a range and key
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(*earlier)), F.lit(0)).alias("_offset"), F.sum("_size").over(Window.partitionBy(*keys)).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy("value").rowsBetween(*earlier)), F.lit(0))
    joined = ranged.withColumn("_within", within).join(offsets, [*keys, "_part"])
    return joined.select(*keys, "value", "n", (F.col("_within") + F.col("_offset")).alias("before"), "total")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, before, total): each distinct number in the column's own type, its rows, the rows of smaller ones and all rows; nulls and NaN are left out."""
    kind = df.schema[column].dataType
    value = F.col(column) if isinstance(kind, T.NumericType) else F.col(column).cast("double")
    kind = kind if isinstance(kind, T.NumericType) else T.DoubleType()
    return _counted_up(df.select(value.alias("value")).where(_is_number(F.col("value"), kind)).groupBy("value").agg(F.count(F.lit(1)).alias("n")), [])


def _compared(df: DataFrame, column: str) -> Column:
    """The column as :func:`value_counts` compares it."""
    return F.col(column) if isinstance(df.schema[column].dataType, T.NumericType) else F.col(column).cast("double")


def with_average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the column's ranks from 1, ties at their mean; null where there is no value."""
    ranks = value_counts(df, column).select(F.col("value").alias("_value"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, _compared(df, column) == F.col("_value"), "left").drop("_value")


def quantile_table(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, count, q): exact quantiles (doubles, linear between neighbours, an array beside ``shares``) of each column in each group.

    One scan for all columns; columns and groups without numbers have no row; null keys are a group.
    """
    by = list(by)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = df.select(*by, cells.alias("_c")).select(*by, "_c.*").where("value is not null and not isnan(value)")
    keys = {k: f"_key{i}" for i, k in enumerate(by)}
    # null keys as structs, so that joins find them
    long = long.select(*(F.struct(k).alias(v) for k, v in keys.items()), "column", "value")
    counts = _counted_up(long.groupBy(*keys.values(), "column", "value").agg(F.count(F.lit(1)).alias("n")), [*keys.values(), "column"])
    picked = []
    for s in shares:
        at = (F.col("total") - 1) * F.lit(float(s))
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        low, high = (F.max(F.when(holds(k), F.col("value"))) for k in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        picked.append(low + (high - low) * part)
    out = counts.groupBy(*keys.values(), "column").agg(F.max("total").alias("count"), F.array(*picked).alias("q"))
    return out.select(*(F.col(f"{v}.{k}").alias(k) for k, v in keys.items()), "column", "count", "q")


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, value) of one column; no rows for a column without numbers."""
    rows = F.explode(F.arrays_zip(F.array(*map(F.lit, map(float, shares))).alias("share"), F.col("q").alias("value")))
    return quantile_table(df, [column], shares).select(rows.alias("r")).select("r.share", "r.value")
