"""Interrupted time series: level and slope change at an event, with HAC (Newey-West) errors.

:func:`fit` takes one series, :func:`fit_groups` any number of them in the same jobs.

The series is period-aggregated.  Its cross products and the lagged score products of the
HAC covariance are aggregated on Spark; k x k matrices are solved on the driver, those of
groups in tasks, a row a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.functions.distributions import Z95, z_two_sided
from kpi_spark.operators.periods import numbered

DESIGN = ("const", "trend", "level_change", "slope_change")


@dataclass(frozen=True)
class Its:
    """Coefficients and their HAC covariance, and the tables that follow from them."""

    terms: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    start: int
    lags: int
    design: DataFrame

    def coefficients(self) -> DataFrame:
        """(term, coef, se, z, p, low_95, high_95)."""
        rows = []
        for i, term in enumerate(self.terms):
            b, se = float(self.beta[i]), float(np.sqrt(max(self.covariance[i, i], 0)))
            z = b / se if se else float("inf")
            rows.append((term, b, se, z, z_two_sided(z), b - Z95 * se, b + Z95 * se))
        return self.design.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, low_95 double, high_95 double")

    def effects(self) -> DataFrame:
        """(order, effect, low, high, cumulative, cumulative_low, cumulative_high) from the event on."""
        b1, b2 = map(float, self.beta[2:4])
        c11, c12, c22 = (float(self.covariance[i, j]) for i, j in ((2, 2), (2, 3), (3, 3)))
        tau = F.col("slope_change")
        run = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n, s = F.count(F.lit(1)).over(run), F.sum("slope_change").over(run)
        deviation = lambda a, b: F.sqrt(F.greatest(F.lit(0.0), c11 * a * a + 2 * c12 * a * b + c22 * b * b))
        point, total = b1 + b2 * tau, b1 * n + b2 * s
        post = self.design.where(F.col("level_change") == 1)
        return post.select(
            "period",
            point.alias("effect"),
            (point - Z95 * deviation(F.lit(1.0), tau)).alias("low"),
            (point + Z95 * deviation(F.lit(1.0), tau)).alias("high"),
            total.alias("cumulative"),
            (total - Z95 * deviation(n, s)).alias("cumulative_low"),
            (total + Z95 * deviation(n, s)).alias("cumulative_high"),
        )


def fit(series: DataFrame, order: str, y: str, event: str, controls: Sequence[str] = ()) -> Its:
    """series: one row a period; event: a column above 0 while the event is on; at least 8 periods before and 4 from its start on."""
    rows = numbered(series, [], order)
    bounds = rows.agg(F.min(F.when(F.coalesce(F.col(event), F.lit(0)) > 0, F.col("i"))).alias("start"), F.count(F.lit(1)).alias("n")).first()
    start, n = bounds["start"], bounds["n"]
    if start is None:
        raise ValueError("the event doesn't meet the series")
    if start < 8 or n - start < 4:
        raise ValueError("at least 8 periods before the event and 4 from its start on are needed")
    lags = max(1, min(int(np.sqrt(n)), n - 1))
    t = F.col("i").cast("double")
    design = rows.select(
        F.col(order).alias("period"),
        "i",
        F.col(y).cast("double").alias("y"),
        F.lit(1.0).alias("const"),
        t.alias("trend"),
        (t >= start).cast("double").alias("level_change"),
        F.greatest(F.lit(0.0), t - start).alias("slope_change"),
        *(F.col(c).cast("double").alias(f"control_{c}") for c in controls),
    )
    terms = (*DESIGN, *(f"control_{c}" for c in controls))
    k = len(terms)
    cells = [F.sum(F.col(a) * F.col(b)) for a in terms for b in [*terms, "y"]]
    cross = np.array(design.agg(F.array(*cells).alias("g")).first()["g"]).reshape(k, k + 1)
    inverse = np.linalg.pinv(cross[:, :k], hermitian=True)
    beta = inverse @ cross[:, k]
    predicted = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, terms, strict=True)), F.lit(0.0))
    scored = design.withColumn("e", F.col("y") - predicted)
    # scores of each period against those up to ``lags`` periods before, weighed by Bartlett's kernel
    past = scored.select(F.col("i").alias("_i"), F.col("e").alias("_e"), *(F.col(c).alias(f"_{c}") for c in terms))
    lagged = scored.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("_i", F.col("i") - F.col("lag")).join(past, "_i")
    weight = F.col("e") * F.col("_e") * (1 - F.col("lag") / F.lit(lags + 1.0))
    meat = np.array(lagged.agg(F.array(*(F.sum(weight * F.col(a) * F.col(f"_{b}") * F.when(F.col("lag") == 0, 0.5).otherwise(1.0)) for a in terms for b in terms)).alias("g")).first()["g"]).reshape(k, k)
    return Its(terms, beta, inverse @ (meat + meat.T) @ inverse, int(start), lags, scored)


@dataclass(frozen=True)
class ItsGroups:
    """The models of many series (by: their key, terms: of each) and the tables that follow from them."""

    by: tuple[str, ...]
    terms: tuple[str, ...]
    models: DataFrame
    design: DataFrame

    def coefficients(self) -> DataFrame:
        """(by, term, coef, se, z, p, low_95, high_95)."""
        return self.models.select(*self.by, F.explode("rows").alias("r")).select(*self.by, "r.*")

    def effects(self) -> DataFrame:
        """(by, period, effect, low, high, cumulative, cumulative_low, cumulative_high) from each event on."""
        post = self.design.where("level_change = 1").join(self.models.select(*self.by, "beta", "covariance"), list(self.by))
        k, tau = len(self.terms), F.col("slope_change")
        b1, b2 = (F.get("beta", F.lit(i)) for i in (2, 3))
        c11, c12, c22 = (F.get("covariance", F.lit(i * k + j)) for i, j in ((2, 2), (2, 3), (3, 3)))
        run = Window.partitionBy(*self.by).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n, s = F.count(F.lit(1)).over(run), F.sum("slope_change").over(run)
        deviation = lambda a, b: F.sqrt(F.greatest(F.lit(0.0), c11 * a * a + 2 * c12 * a * b + c22 * b * b))
        point, total, one = b1 + b2 * tau, b1 * n + b2 * s, deviation(F.lit(1.0), tau)
        columns = {"effect": point, "low": point - Z95 * one, "high": point + Z95 * one, "cumulative": total, "cumulative_low": total - Z95 * deviation(n, s), "cumulative_high": total + Z95 * deviation(n, s)}
        return post.select(*self.by, "period", *(c.alias(name) for name, c in columns.items()))


def fit_groups(series: DataFrame, order: str, y: str, event: str, by: Sequence[str], controls: Sequence[str] = ()) -> ItsGroups:
    """Every series (one row a period and key ``by``, without null keys) by its own model; those without 8 periods before their event and 4 from it on are left out.

    Cross products and lagged score products of all series are two grouped aggregates; a period meets
    its earlier ones by an equi-join on (key, place), so a task holds neither a series nor its lags.
    """
    by = list(by)
    every = Window.partitionBy(*by)
    rows = numbered(series, by, order).withColumn("_start", F.min(F.when(F.coalesce(F.col(event), F.lit(0)) > 0, F.col("i"))).over(every)).where("_start >= 8 and n - _start >= 4")
    t = F.col("i").cast("double")
    design = rows.select(
        *by,
        F.col(order).alias("period"),
        "i",
        F.greatest(F.lit(1), F.least(F.floor(F.sqrt("n")), F.col("n") - 1)).cast("int").alias("_lags"),
        F.col(y).cast("double").alias("y"),
        F.lit(1.0).alias("const"),
        t.alias("trend"),
        (t >= F.col("_start")).cast("double").alias("level_change"),
        F.greatest(F.lit(0.0), t - F.col("_start")).alias("slope_change"),
        *(F.col(c).cast("double").alias(f"control_{c}") for c in controls),
    )
    terms = (*DESIGN, *(f"control_{c}" for c in controls))
    k = len(terms)
    kinds = "".join(f"`{c}` {kind}, " for c, kind in design.select(*by).dtypes)

    def solved(frames):
        for frame in frames:
            beta, inverse = [], []
            for cells in frame["_cross"]:
                cross = np.array(cells, dtype=float).reshape(k, k + 1)
                inv = np.linalg.pinv(cross[:, :k], hermitian=True)
                beta.append(list(map(float, inv @ cross[:, k])))
                inverse.append(list(map(float, inv.ravel())))
            yield frame[by].assign(beta=beta, _inverse=inverse)

    cross = design.groupBy(*by).agg(F.array(*(F.sum(F.col(a) * F.col(b)) for a in terms for b in [*terms, "y"])).alias("_cross"))
    models = cross.mapInPandas(solved, f"{kinds}beta array<double>, _inverse array<double>")
    predicted = sum((F.get("beta", F.lit(j)) * F.col(c) for j, c in enumerate(terms)), F.lit(0.0))
    scored = design.join(models.drop("_inverse"), by).withColumn("e", F.col("y") - predicted).drop("beta")
    past = scored.select(*by, F.col("i").alias("_i"), F.col("e").alias("_e"), *(F.col(c).alias(f"_{c}") for c in terms))
    lagged = scored.withColumn("lag", F.explode(F.sequence(F.lit(0), F.col("_lags")))).withColumn("_i", F.col("i") - F.col("lag")).join(past, [*by, "_i"])
    weight = F.col("e") * F.col("_e") * (1 - F.col("lag") / (F.col("_lags") + 1.0)) * F.when(F.col("lag") == 0, 0.5).otherwise(1.0)
    meat = lagged.groupBy(*by).agg(F.array(*(F.sum(weight * F.col(a) * F.col(f"_{b}")) for a in terms for b in terms)).alias("_meat"))

    def finished(frames):
        for frame in frames:
            covariance, tables = [], []
            for beta, inverse, cells in zip(frame["beta"], frame["_inverse"], frame["_meat"], strict=True):
                inv, half = np.array(inverse, dtype=float).reshape(k, k), np.array(cells, dtype=float).reshape(k, k)
                c = inv @ (half + half.T) @ inv
                covariance.append(list(map(float, c.ravel())))
                rows_ = []
                for j, term in enumerate(terms):
                    b, se = float(beta[j]), float(np.sqrt(max(c[j, j], 0)))
                    z = b / se if se else float("inf")
                    rows_.append({"term": term, "coef": b, "se": se, "z": z, "p": z_two_sided(z), "low_95": b - Z95 * se, "high_95": b + Z95 * se})
                tables.append(rows_)
            yield pd.DataFrame({**{c: frame[c] for c in by}, "beta": frame["beta"], "covariance": covariance, "rows": tables})

    row = "struct<term string, coef double, se double, z double, p double, low_95 double, high_95 double>"
    done = models.join(meat, by).mapInPandas(finished, f"{kinds}beta array<double>, covariance array<double>, rows array<{row}>")
    return ItsGroups(tuple(by), terms, done, design)
