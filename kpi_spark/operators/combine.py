"""Joins and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _renamed(df: DataFrame, keys: Sequence[str], used: set[str], n: int) -> DataFrame:
    """Columns other than keys that are taken get ``_n`` behind their names."""
    names = {c: f"{c}_{n}" for c in df.columns if c not in keys and c in used}
    return df.withColumnsRenamed(names)


def merge(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Chained inner or outer join of all tables; null keys match; repeated names get ``_1``, ``_2``…"""
    if how not in ("inner", "outer"):
        raise ValueError("how is inner or outer")
    out = tables[0]
    for n, right in enumerate(tables[1:], 1):
        right = _renamed(right, keys, set(out.columns), n)
        right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
        same = reduce(lambda p, q: p & q, (out[k].eqNullSafe(right[f"_right_{k}"]) for k in keys))
        rest = [c for c in out.columns if c not in keys], [c for c in right.columns if not c.startswith("_right_")]
        joined = out.join(right, same, how)
        out = joined.select(*(F.coalesce(out[k], right[f"_right_{k}"]).alias(k) for k in keys), *(out[c] for c in rest[0]), *(right[c] for c in rest[1]))
    return out


def join_two(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join (null keys don't match); repeated names of the right table get ``_r``."""
    names = {c: f"{c}_r" for c in right.columns if c not in on and c in left.columns}
    return left.join(right.withColumnsRenamed(names), list(on), how)


def join_sizes(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """(step, rows) that each step of the chained join would give: products of counts a key, summed."""
    counts = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, t in enumerate(tables)]
    out = merge(counts, keys, "outer")
    steps = []
    for i in range(1, len(tables)):
        names = [f"n{j}" for j in range(i + 1)]
        if how == "inner":
            test = reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in names))
        else:
            test = reduce(lambda p, q: p | q, (F.col(c).isNotNull() for c in names))
        product = reduce(lambda a, b: a * b, (F.coalesce(F.col(c), F.lit(1)) for c in names))
        steps.append(F.sum(F.when(test, product)).alias(f"s{i}"))
    wide = out.agg(*steps)
    pairs = F.array(*(F.struct(F.lit(i).alias("step"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("rows")) for i in range(1, len(tables))))
    return wide.select(F.explode(pairs).alias("s")).select("s.step", "s.rows")


def guarded_merge(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner", limit: int = 5_000_000) -> DataFrame:
    """:func:`merge`, refused where a step would give more than ``limit`` rows."""
    worst = join_sizes(tables, keys, how).agg(F.max("rows")).first()[0] or 0
    if worst > limit:
        raise ValueError(f"the join would give {worst} rows at one step; the limit is {limit}")
    return merge(tables, keys, how)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], aggregates: Iterable[Column]) -> DataFrame:
    """Columns of another table, aggregated by the keys before a left join."""
    return left.join(right.groupBy(*keys).agg(*aggregates), list(keys), "left")


def eligible(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def missing(asked: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    return asked.join(df, list(on), "left_anti")


def incomplete(panel: DataFrame, unit: str, period: str) -> DataFrame:
    """(unit, periods, missing) of units that lack some of the panel's periods."""
    days = panel.agg(F.count_distinct(period).alias("_all"))
    counts = panel.groupBy(unit).agg(F.count_distinct(period).alias("periods"))
    return counts.crossJoin(F.broadcast(days)).where("periods < _all").select(unit, "periods", (F.col("_all") - F.col("periods")).alias("missing"))


def stack(tables: Sequence[DataFrame], mode: str = "all") -> DataFrame:
    """Rows of all tables; all: any column, missing ones null; common: columns that all have, in the first one's order."""
    if mode == "all":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    if not common:
        raise ValueError("the tables have no column in common")
    return reduce(lambda a, b: a.unionByName(b), (t.select(*common) for t in tables))


def combinations(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Distinct rows of some columns."""
    return df.select(*columns).distinct()


def common_values(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.intersect(y)


def only_in_first(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.subtract(y)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicates): rows beyond the first of each kind; by counts of rows, in one shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
