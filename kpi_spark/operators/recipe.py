"""Tables from a declarative recipe: filters, row keys, pivots and aggregates in one plan.

A recipe becomes ``select`` (casts), ``where``, and one ``groupBy().agg()`` with a
conditional aggregate for each category, so flat and pivoted metrics share one shuffle.
Only the discovery of pivot categories and medians run jobs while the plan is built.  Medians
come from ranged counts of all their cells together (:mod:`kpi_spark.operators.ranking`), so a group's
values are spread over tasks, and are joined to the other aggregates by the row keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpi_spark.functions.typing import NULL_LABEL, NUMERIC, filled, typed
from kpi_spark.operators import filters as flt
from kpi_spark.operators import sorting
from kpi_spark.operators.ranking import quantile_table

#: Most categories of a pivot and value columns of a table.
CATEGORIES, VALUE_COLUMNS = 50, 500
ADDITIVE = ("sum", "count", "nunique")
ARITHMETIC = ("sum", "mean", "median", "std")
ORDERED = ("first", "last")
AGGREGATES = ("sum", "mean", "min", "max", "count", "median", "std", "first", "last", "nunique")


def aggregate(kind: str, value: Column, order: str | None = None) -> Column:
    """One of :data:`AGGREGATES`; first and last need a column to order by."""
    simple = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "std": F.stddev_samp, "nunique": F.count_distinct}
    if kind in simple:
        return simple[kind](value)
    if kind in ORDERED:
        if not order:
            raise ValueError(f"{kind} needs an order column")
        # rows without a value don't count, as in every other aggregate
        by = F.when(value.isNotNull(), F.col(order))
        return (F.min_by if kind == "first" else F.max_by)(value, by)
    raise ValueError(f"unknown aggregate: {kind}")


def aggregated(df: DataFrame, by: Sequence[str], cells: Sequence[tuple[str, str, Column]], order: str | None = None) -> DataFrame:
    """(by, one column a cell): cells are (name, aggregate, value)."""
    by, medians = list(by), [(name, value) for name, kind, value in cells if kind == "median"]
    plain = [(aggregate(kind, value, order)).alias(name) for name, kind, value in cells if kind != "median"]
    if not medians:
        return df.groupBy(*by).agg(*plain)
    keys, held = {c: f"_by{i}" for i, c in enumerate(by)}, {f"_m{i}": value.cast("double") for i, (_, value) in enumerate(medians)}
    source = df.select(*(F.col(c).alias(k) for c, k in keys.items()), *(v.alias(m) for m, v in held.items()))
    found = quantile_table(source, list(held), [0.5], list(keys.values()))
    found = found.groupBy(*keys.values()).agg(*(F.max(F.when(F.col("column") == m, F.get("q", F.lit(0)))).alias(name) for m, (name, _) in zip(held, medians, strict=True)))
    groups = df.groupBy(*by).agg(*plain) if plain else df.select(*by).distinct() if by else df.groupBy().agg(F.count(F.lit(1)).alias("_rows"))
    same = [groups[c].eqNullSafe(found[k]) for c, k in keys.items()]
    both = groups.join(found, reduce(lambda p, q: p & q, same), "left") if by else groups.crossJoin(F.broadcast(found))  # one row each
    return both.select(*by, *(F.col(f"`{name}`") for name, _, _ in cells))


def group(df: DataFrame, by: list[str], aggregates: Mapping[str, str], order: str | None = None) -> DataFrame:
    """Group-by with one aggregate a column, under the column's name."""
    return aggregated(df, by, [(c, k, F.col(c)) for c, k in aggregates.items()], order)


def totals(df: DataFrame, aggregates: Mapping[str, str], order: str | None = None) -> DataFrame:
    """(metric, value) over all rows."""
    wide = group(df, [], aggregates, order).select(*(F.col(c).cast("double").alias(c) for c in aggregates))
    return wide.unpivot([], list(aggregates), "metric", "value")


def pivot_key(columns: list[str], label: str = NULL_LABEL) -> Column:
    return F.concat_ws(" | ", *(filled(c, label) for c in columns))


def categories(df: DataFrame, columns: list[str], most: int = CATEGORIES) -> list[str]:
    """The pivot's categories, sorted; an error beyond ``most``."""
    found = df.select(pivot_key(columns).alias("k")).distinct().orderBy("k").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the pivot has more than {most} categories")
    return [r["k"] for r in found]


@dataclass(frozen=True)
class TableRecipe:
    """What a table shows.

    rows: group keys; columns: what the pivoted metrics are split by; values: (metric,
    aggregate) pairs, a blank aggregate counts; pivoted: the metrics to split (None: all,
    if there are columns); types: semantic types by column; filters: allowed values by
    column (none: no rows); order: (result column, asc or desc); strict: a number cast that
    fails is an error; order_by: what first and last go by.
    """

    rows: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    values: tuple[tuple[str, str], ...] = ()
    pivoted: tuple[str, ...] | None = None
    filters: Mapping[str, list | None] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    order: tuple[tuple[str, str], ...] = ()
    selected: tuple[str, ...] = ()
    order_by: str | None = None
    strict: bool = True
    cats: tuple[str, ...] | None = None

    def source(self, df: DataFrame) -> DataFrame:
        """Filtered rows (on the columns as they are, so filters reach the scan) of the needed columns, cast."""
        needed = dict.fromkeys([*self.rows, *self.columns, *(m for m, _ in self.values), *self.selected, *([self.order_by] if self.order_by else [])])
        if not needed:
            needed = dict.fromkeys(c for c in df.columns if self.types.get(c) != "ignorar")
        absent = [c for c in [*needed, *self.filters] if c not in df.columns]
        if absent:
            raise ValueError(f"no such columns: {absent}")
        return flt.value_filter(df, self.filters).select(*(typed(c, self.types.get(c, "auto"), self.strict) for c in needed))

    def checked(self, df: DataFrame) -> list[tuple[str, str, str]]:
        """(metric, aggregate, result name) of each value."""
        out, names = [], set()
        for metric, kind in self.values:
            kind = kind or "count"
            if kind not in AGGREGATES:
                raise ValueError(f"unknown aggregate: {kind}")
            if kind in ARITHMETIC and not isinstance(df.schema[metric].dataType, NUMERIC):
                raise ValueError(f"{kind} needs a numeric column: {metric}")
            name = f"{metric} · {kind}" if metric in names else metric
            names.add(name)
            out.append((metric, kind, name))
        return out

    def to_df(self, df: DataFrame) -> DataFrame:
        src = self.source(df)
        if not self.values:
            return self._headings(src) if self.columns else src.select(*(self.rows or src.columns)).distinct()
        values = self.checked(src)
        split = [v for v in values if self.columns and (self.pivoted is None or v[0] in self.pivoted)]
        cats = list(self.cats) if self.cats is not None else categories(src, list(self.columns)) if split else []
        if len(cats) * len(split) + len(values) - len(split) > VALUE_COLUMNS:
            raise ValueError(f"the table has more than {VALUE_COLUMNS} value columns")
        key = pivot_key(list(self.columns)) if split else None
        src = src.withColumn("_key", key) if split else src
        cells, additive = [], []
        for metric, kind, name in values:
            if (metric, kind, name) not in split:
                cells.append((name, kind, F.col(metric)))
                continue
            for cat in cats:
                cells.append((f"{name} · {cat}" if len(split) > 1 else cat, kind, F.when(F.col("_key") == cat, F.col(metric))))
                additive += [cells[-1][0]] if kind in ADDITIVE else []
        if not cells:  # nothing to split by
            return src.select(*self.rows).distinct()
        table = aggregated(src, self.rows, cells, self.order_by)
        table = table.select(*self.rows, *((F.coalesce(F.col(f"`{n}`"), F.lit(0)) if n in additive else F.col(f"`{n}`")).alias(n) for n, _, _ in cells))
        order = self.order or [(r, "asc") for r in self.rows]
        return sorting.sort(table, order) if order else table

    def _headings(self, src: DataFrame) -> DataFrame:
        """A pivot without metrics: row keys and an empty column for each category."""
        cats = list(self.cats) if self.cats is not None else categories(src, list(self.columns))
        return src.select(*self.rows).distinct().select(*self.rows, *(F.lit(None).cast(T.StringType()).alias(c) for c in cats))


def classic_pivot(df: DataFrame, index: str, column: str, values: Mapping[str, str], cats: list[str], metric_first: bool = True, fill: float = 0) -> DataFrame:
    """One index, one column, several values; every missing cell is ``fill``; names join metric and category."""
    name = lambda m, c: f"{m} - {c}" if metric_first else f"{c} - {m}"
    key = filled(column)
    cells = [F.coalesce(aggregate(k, F.when(key == c, F.col(m))), F.lit(fill)).alias(name(m, c)) for m, k in values.items() for c in cats]
    return df.groupBy(index).agg(*cells)
