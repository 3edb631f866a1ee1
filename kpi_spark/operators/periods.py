"""Calendar periods, event windows and time-series operators.

Windows over a whole series run on period-aggregated rows and are partitioned by series;
raw rows only meet grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.functions.typing import NULL_LABEL, filled

# fixed values: shares of a series at which pseudo-interventions cut it, and the least that comes before a cut
CUTS, LEAST_SHARE, LEAST_TRAIN = (0.55, 0.7, 0.82), 0.45, 8
# fixed values: median days between periods up to which a series is daily, weekly, monthly, quarterly
GAPS = ((2, "D"), (10, "W"), (45, "M"), (120, "Q"))

UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_STEP = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}


def period(column: str, freq: str) -> Column:
    """The first day of the period; weeks start on Monday."""
    return F.date_trunc(UNITS[freq], F.col(column)).cast("date")


def aggregate(df: DataFrame, date: str, freq: str, values: Iterable[str], dims: Iterable[str] = (), fill_gaps: bool = False) -> DataFrame:
    """(period, dims, sums); rows without a date are left out; fill_gaps: periods without rows are 0."""
    dims, values = list(dims), list(values)
    dated = df.where(F.col(date).isNotNull())
    out = dated.groupBy(period(date, freq).alias("period"), *dims).agg(*(F.sum(v).alias(v) for v in values))
    return fill(out, freq, values, dims, dated.select(period(date, freq).alias("period"))) if fill_gaps else out


def fill(series: DataFrame, freq: str, values: Iterable[str], dims: Iterable[str] = (), dates: DataFrame | None = None) -> DataFrame:
    """Every period from the first to the last one for every series; what is missing is 0.

    Each row gives its own period and the empty ones up to its series' next row (the first row also
    those before it), so only the rows there are get shuffled, not series x periods.  dates: rows
    with the same first and last period, where they cost less than a second pass over ``series``.
    """
    dims, values = list(dims), list(values)
    span = (series if dates is None else dates).agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null")
    grid = span.select(F.sequence("a", "b", F.expr(_STEP[freq])).alias("_grid"))
    places = grid.select(F.posexplode("_grid").alias("_place", "period"))
    placed = series.join(F.broadcast(places), "period", "left").withColumn("_at", F.coalesce("_place", F.lit(-1)))  # -1: not in the grid
    order = Window.partitionBy(*dims).orderBy("_at")
    placed = placed.withColumns({"_before": F.lag("_at").over(order), "_next": F.lead("_at").over(order)})
    first = F.when(F.col("_before").isNull(), 0).otherwise(F.greatest("_at", F.lit(0)))
    last = F.greatest(F.col("_at"), F.coalesce("_next", F.size("_grid")) - 1)
    cells = placed.crossJoin(F.broadcast(grid)).withColumn("_period", F.explode(F.slice("_grid", first + 1, last - first + 1)))
    return cells.select(F.col("_period").alias("period"), *dims, *(F.coalesce(F.when(F.col("_period") == F.col("period"), F.col(v)), F.lit(0)).alias(v) for v in values))


def series_name(dims: Iterable[str], label: str = NULL_LABEL) -> Column:
    dims = list(dims)
    return F.concat_ws(" | ", *(filled(F.trim(F.col(d).cast("string")), label) for d in dims)) if dims else F.lit("total")


def long_series(df: DataFrame, date: str, freq: str, value: str, dims: Iterable[str] = ()) -> DataFrame:
    """(period, series, value) with every period of every series."""
    dated = df.where(F.col(date).isNotNull())
    named = dated.groupBy(period(date, freq).alias("period"), series_name(dims).alias("series")).agg(F.sum(value).alias("value"))
    return fill(named, freq, ["value"], ["series"], dated.select(period(date, freq).alias("period")))


def wide_series(series: DataFrame, names: list[str]) -> DataFrame:
    """A column for each series, 0 where it has no row."""
    cells = [F.coalesce(F.sum(F.when(F.col("series") == n, F.col("value"))), F.lit(0)).alias(n) for n in names]
    return series.groupBy("period").agg(*cells)


def period_means(df: DataFrame, date: str, freq: str, columns: Iterable[str]) -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(period(date, freq).alias("period")).agg(*(F.avg(c).alias(c) for c in columns))


def with_covariates(series: DataFrame, covariates: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Covariates joined by period; what is missing is the column's mean."""
    columns = list(columns)
    means = covariates.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)))
    joined = series.join(covariates.select("period", *columns), "period", "left").crossJoin(F.broadcast(means))
    return joined.select(*series.columns, *(F.coalesce(F.col(c), F.col(f"_m{i}")).alias(c) for i, c in enumerate(columns)))


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(column).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(column, "_mean")).drop("_mean")


def series_list(df: DataFrame, dims: list[str]) -> DataFrame:
    """(series, task) of each combination of dimensions."""
    clean = df.select(*(filled(F.trim(F.col(d).cast("string"))).alias(d) for d in dims)).distinct()
    task = F.concat_ws(";", *(F.concat(F.lit(f"{d}="), F.col(d)) for d in dims))
    return clean.select(F.concat_ws(" | ", *dims).alias("series"), task.alias("task"))


# -- events ------------------------------------------------------------------------------


def event_columns(df: DataFrame, events: DataFrame, date: str, labels: list[str]) -> DataFrame:
    """An indicator column a label: the summed intensity of the windows that hold the row's day.

    events: (name, start, end, intensity, grp, own); a window's label is its group unless it stands
    on its own.  Windows are joined to the distinct days only, by month first, so a long list of
    windows needs no nested loop over rows.
    """
    day = F.to_date(F.col(date))
    windows = events.select(F.when(F.col("own"), F.col("name")).otherwise(F.col("grp")).alias("label"), "intensity", F.to_date("start").alias("a"), F.to_date("end").alias("b"))
    months = windows.where("a <= b").withColumn("month", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))))
    days = df.select(day.alias("_day")).where("_day is not null").distinct().withColumn("month", F.trunc("_day", "month"))
    inside = days.join(months, "month").where("_day between a and b")
    cells = [F.coalesce(F.sum(F.when(F.col("label") == n, F.col("intensity"))), F.lit(0.0)).alias(n) for n in labels]
    found = inside.groupBy("_day").agg(*cells)
    joined = df.withColumn("_d", day).join(found, F.col("_d") == F.col("_day"), "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in labels))


def snap(dates: DataFrame, periods: DataFrame, mode: str) -> DataFrame:
    """(date, snapped): the available period at or before (floor), at or after (ceil) or nearest to each date; clamped at the ends.

    Both sides meet in one ordered union, so no pairs of dates and periods are formed.
    """
    one = dates.select("date").distinct().select(F.col("date").alias("d"), F.lit(None).cast("date").alias("p"))
    two = periods.select(F.col("period").alias("d"), F.col("period").alias("p")).distinct()
    both = one.unionByName(two)
    below = F.max("p").over(Window.orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.min("p").over(Window.orderBy("d").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.select("d", "p", below.alias("lo"), above.alias("hi")).where("p is null")
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    pick = {"floor": lo, "ceil": hi, "nearest": F.when(F.datediff("d", lo) <= F.datediff(hi, "d"), lo).otherwise(hi)}[mode]
    return found.select(F.col("d").alias("date"), pick.alias("snapped"))


# -- windows -----------------------------------------------------------------------------


def moving_average(df: DataFrame, value: str, by: list[str], order: str, k: int = 2) -> Column:
    """The mean of a row and the ``k - 1`` after it."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(0, k - 1))


def cumulative(value: str | Column, by: list[str], order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def granularity(df: DataFrame, date: str, by: list[str] = ()) -> DataFrame:
    """(by, days, median_gap, granularity) from the gaps between distinct days."""
    days = df.select(*by, F.to_date(F.col(date)).alias("day")).where("day is not null").distinct()
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy(*by).orderBy("day"))))
    out = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.median("gap").alias("median_gap"))
    g = F.col("median_gap")
    return out.withColumn("granularity", reduce(lambda e, gap: e.when(g <= gap[0], gap[1]), GAPS, F.when(F.col("days") < 3, "Original")).otherwise("Y"))


def consecutive(df: DataFrame, date: str) -> DataFrame:
    """(days, gaps, with_time): gaps of more than a day, and rows that carry a time of day."""
    stamps = df.agg(F.count_if(F.col(date).cast("timestamp") != F.date_trunc("day", F.col(date))).alias("with_time"))
    days = df.select(F.to_date(F.col(date)).alias("day")).where("day is not null").distinct()
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.orderBy("day"))))
    return gaps.agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("gap") > 1).alias("gaps")).crossJoin(stamps)


def average_rank(value: str, by: list[str] = ()) -> Column:
    """Ranks with ties at their mean."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """With ``i`` (from 0) and ``n``, the place in and length of each series."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def correlation_stability(pairs: DataFrame, by: list[str], x: str, y: str, order: str) -> DataFrame:
    """(by, stability): mean less population deviation of the correlations in three overlapping windows of half the series (6 at least)."""
    rows = numbered(pairs, by, order).withColumn("width", F.greatest(F.lit(6), F.floor(F.col("n") / 2).cast("int")))
    first = F.array_distinct(F.array(F.lit(0), F.greatest(F.lit(0), (F.col("n") - F.col("width")).cast("int")), F.greatest(F.lit(0), F.floor((F.col("n") - F.col("width")) / 2).cast("int"))))
    inside = rows.withColumn("start", F.explode(first)).where((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + F.col("width")))
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    inside = inside.withColumns({x: F.when(both, F.col(x)), y: F.when(both, F.col(y))})
    r = F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12) & (F.count(F.lit(1)) >= 4), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    each = inside.groupBy(*by, "start").agg(r.alias("r"))
    return each.groupBy(*by).agg((F.avg("r") - F.stddev_pop("r")).alias("stability"))


def expanding_folds(df: DataFrame, by: list[str], order: str, predictors: int) -> DataFrame:
    """Rows of each fold with ``fold`` and ``test``: expanding windows, up to 5 folds of equal test size, each train set long enough."""
    least = max(10, predictors + 3)
    rows = numbered(df, by, order)
    folds = F.array_max(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda k: F.when((F.floor(F.col("n") / (k + 1)) >= least) & (k <= F.col("n") - 1), k)))
    rows = rows.withColumn("folds", folds).where("folds is not null").withColumn("size", F.floor(F.col("n") / (F.col("folds") + 1)))
    out = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("folds")))).withColumn("cut", F.col("n") - (F.col("folds") - F.col("fold") + 1) * F.col("size"))
    return out.where(F.col("i") < F.col("cut") + F.col("size")).withColumn("test", F.col("i") >= F.col("cut")).drop("size", "folds")


def pseudo_cuts(df: DataFrame, by: list[str], order: str, controls: int | Column = 1) -> DataFrame:
    """Rows of each pseudo-intervention with ``fold`` and ``test``: cuts at 55, 70 and 82 percent, tests of a tenth (2 at least)."""
    rows = numbered(df, by, order).where("n >= 15")
    n = F.col("n")
    least = F.greatest(F.lit(LEAST_TRAIN), controls + F.lit(4), F.floor(n * F.lit(LEAST_SHARE)).cast("int"))
    cuts = F.array_distinct(F.array(*(F.least((n - 2).cast("int"), F.greatest(least, F.floor(n * F.lit(s)).cast("int"))) for s in CUTS)))
    out = rows.select("*", F.posexplode(cuts).alias("fold", "cut")).withColumn("size", F.greatest(F.lit(2), F.floor(n * F.lit(0.1)).cast("int")))
    return out.where(F.col("i") < F.col("cut") + F.col("size")).withColumn("test", F.col("i") >= F.col("cut")).drop("size")


def holdout(df: DataFrame, by: list[str], order: str, share: float = 0.2) -> DataFrame:
    """With ``test``: the last fifth (2 rows at least) of each series."""
    rows = numbered(df, by, order)
    return rows.withColumn("test", F.col("i") >= F.col("n") - F.greatest(F.lit(2), F.ceil(F.col("n") * F.lit(share)).cast("int")))


def seasonality(df: DataFrame, by: list[str], value: str, order: str, candidates: Iterable[int]) -> DataFrame:
    """(by, season, strength): the variance that phase means explain after a linear trend, for periods with three complete cycles."""
    rows = numbered(df.where(F.col(value).isNotNull()), by, order)
    keys = [*by]
    trend = rows.groupBy(*keys).agg(F.regr_slope(value, "i").alias("_b"), F.regr_intercept(value, "i").alias("_a"))
    joined = rows.join(trend, keys) if keys else rows.crossJoin(F.broadcast(trend))
    rest = joined.withColumn("e", F.col(value) - F.col("_a") - F.col("_b") * F.col("i"))
    cycles = rest.withColumn("season", F.explode(F.array(*map(F.lit, candidates)))).where((F.col("n") >= 3 * F.col("season")) & (F.col("i") < F.floor(F.col("n") / F.col("season")) * F.col("season")))
    phases = cycles.groupBy(*keys, "season", F.pmod("i", "season").alias("phase")).agg(F.sum(F.col("e") * F.col("e")).alias("ss"), F.avg("e").alias("m"), F.count(F.lit(1)).alias("k"))
    total = F.sum("ss")
    left = F.sum(F.col("ss") - F.col("k") * F.col("m") * F.col("m"))
    return phases.groupBy(*keys, "season").agg(F.greatest(F.lit(0.0), 1 - F.try_divide(left, total)).alias("strength"))


def best_season(strengths: DataFrame, by: list[str], least: float = 0.15) -> DataFrame:
    """(by, season, strength): the strongest one; null where it is too weak."""
    best = strengths.groupBy(*by).agg(F.max(F.struct("strength", "season")).alias("b"))
    return best.select(*by, F.when(F.col("b.strength") >= least, F.col("b.season")).alias("season"), F.col("b.strength").alias("strength"))


def window_of(df: DataFrame, date: str, positions: Iterable[int]) -> DataFrame:
    """(first, last): the days at the least and the greatest of the positions, brought into range."""
    positions = sorted(positions)
    days = numbered(df.select(F.to_date(F.col(date)).alias("day")).where("day is not null").distinct(), [], "day")
    clamp = lambda p: F.least(F.greatest(F.lit(p), F.lit(0)), F.col("n") - 1)
    return days.agg(F.max(F.when(F.col("i") == clamp(positions[0]), F.col("day"))).alias("first"), F.max(F.when(F.col("i") == clamp(positions[-1]), F.col("day"))).alias("last"))

