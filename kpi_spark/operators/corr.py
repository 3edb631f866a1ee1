"""Correlation: every pair in one ``agg``, null-safe and free of division errors."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpi_spark.functions.typing import numeric_columns
from kpi_spark.operators.periods import average_rank
from kpi_spark.operators.ranking import with_average_rank
from kpi_spark.sources.scratch import scratch_path

#: Distinct pairs of values of a range, and ranges of a column at most, in Kendall's tau.
RANGE, RANGES = 500_000, 1000


def pearson(x: str, y: str) -> Column:
    """Over rows that have both; null for a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pairs(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """(x, y, r) of every pair of numeric columns."""
    columns = columns or numeric_columns(df)
    both = list(combinations(columns, 2))
    wide = df.agg(*(pearson(x, y).alias(f"r{i}") for i, (x, y) in enumerate(both)))
    rows = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.round(F.col(f"r{i}"), digits).alias("r")) for i, (x, y) in enumerate(both)))
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def strong(pairs_: DataFrame, above: float = 0.7) -> DataFrame:
    return pairs_.where(F.abs("r") > above)


def banded(pairs_: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of at least ``least``, strongest first, with a band."""
    band = F.when(F.abs("r") >= 0.9, "very strong").when(F.abs("r") >= 0.7, "strong").otherwise("moderate")
    return pairs_.where(F.abs("r") >= least).withColumn("band", band).orderBy(F.desc(F.abs("r")), "x", "y")


def spread(df: DataFrame, columns: list[str], least: float = 1e-12) -> list[str]:
    """The columns that vary."""
    row = df.agg(*(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row[f"s{i}"] is not None and row[f"s{i}"] > least]


def by_method(df: DataFrame, columns: list[str], method: str = "pearson", by: list[str] = (), digits: int = 3) -> DataFrame:
    """Pearson, Spearman (average ranks) or Kendall (tau-b).

    Groups (``by``) are for Spearman only.
    """
    if method == "pearson":
        return pairs(df, columns, digits)
    if method == "spearman":
        whole = df.dropna(subset=columns)
        if not by:
            for i, c in enumerate(columns):
                whole = with_average_rank(whole, c, f"_r{i}")
            return pairs(whole.select(*(F.col(f"_r{i}").alias(c) for i, c in enumerate(columns))), columns, digits)
        return pairs(whole.select(*(average_rank(c, list(by)).alias(c) for c in columns)), columns, digits)
    whole = df.dropna(subset=columns)
    rows = [(x, y, kendall(whole, x, y)) for x, y in combinations(columns, 2)]  # a row a pair of columns
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double").withColumn("r", F.round("r", digits))


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """The weight of all pairs, earlier times later, in which the earlier value is greater; by merging."""
    if len(values) < 2:
        return 0
    half = len(values) // 2
    below = inversions(values[:half], weights[:half]) + inversions(values[half:], weights[half:])
    order = np.argsort(values[:half], kind="stable")
    passed = np.concatenate(([0], np.cumsum(weights[:half][order])))
    least = np.searchsorted(values[:half][order], values[half:], "right")
    return below + sum((weights[half:].astype(object) * (passed[-1] - passed[least])).tolist())


def kendall(df: DataFrame, x: str, y: str, per_range: int = RANGE) -> float | None:
    """tau-b of two numeric columns without nulls; None where one of them is constant.

    Distinct pairs of values are counted and cut into ranges of x and ranges of y (equal values stay together).  Discordant
    pairs of rows that differ in both ranges come from the grid of the ranges' totals, which is bounded;
    those in one range of y, and those in one range of x but not of y, are counted by merging, a task a range.
    """
    spark = df.sparkSession

    def ranged(table: DataFrame, column: str, name: str, n: int) -> DataFrame:
        path = scratch_path(spark, "kendall")
        (table.repartitionByRange(n, column) if n > 1 else table.coalesce(1)).withColumn(name, F.spark_partition_id()).write.parquet(path)
        return spark.read.parquet(path)

    counts = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = ranged(counts, "x", "a", max(1, min(RANGES, df.count() // per_range)))
    cells = ranged(counts, "y", "c", max(1, min(RANGES, counts.count() // per_range)))
    tied = lambda *by: cells.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum((F.col("n").cast("decimal(19,0)") * (F.col("n") - 1))).alias("t"), F.sum(F.col("n")).alias("n")).first()
    of_x, of_y, of_both = tied("x"), tied("y"), tied("x", "y")
    n = of_x["n"] or 0
    every, ties_x, ties_y, both = n * (n - 1) // 2, *(int(t["t"] or 0) // 2 for t in (of_x, of_y, of_both))

    def within(part: str, value: str) -> int:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            order = np.lexsort((frame[value].to_numpy(), frame["x"].to_numpy()))
            return pd.DataFrame({"k": [str(inversions(frame[value].to_numpy()[order], frame["n"].to_numpy()[order]))]})

        several = cells.groupBy(part).agg(F.min("x").alias("_l"), F.max("x").alias("_h"), F.min(value).alias("_b"), F.max(value).alias("_t")).where("_l < _h and _b < _t").select(part)  # of one value alone there are no inversions
        return sum(int(r["k"]) for r in cells.join(several, part, "left_semi").groupBy(part).applyInPandas(run, "k string").collect())  # a row a range

    grid = cells.groupBy("a", "c").agg(F.sum("n").alias("n")).collect()  # RANGES x RANGES at most
    table = np.zeros((max((r["a"] for r in grid), default=0) + 1, max((r["c"] for r in grid), default=0) + 1), dtype=object)
    for r in grid:
        table[r["a"], r["c"]] = r["n"]
    earlier = np.zeros_like(table)
    earlier[1:] = np.cumsum(table, axis=0)[:-1]  # of ranges of smaller x
    greater = np.zeros_like(table)
    greater[:, :-1] = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1][:, 1:]  # and of greater y
    discordant = int((table * greater).sum()) + within("c", "y") + within("a", "c")
    scale = float(every - ties_x) * float(every - ties_y)
    return (every - ties_x - ties_y + both - 2 * discordant) / scale**0.5 if scale > 0 else None


def with_target(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, r) with the target."""
    wide = df.agg(*(pearson(c, target).alias(f"r{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("r")) for i, c in enumerate(columns)))
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif): the diagonal of the inverse correlation matrix (p x p on the driver)."""
    found = {(r["x"], r["y"]): r["r"] for r in pairs(df.dropna(subset=columns), columns, 12).collect()}
    matrix = np.eye(len(columns))
    for i, x in enumerate(columns):
        for j, y in enumerate(columns):
            if i < j:
                matrix[i, j] = matrix[j, i] = found[(x, y)] or 0.0
    values = np.diag(np.linalg.pinv(matrix, hermitian=True))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "column string, vif double")
