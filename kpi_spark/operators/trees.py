"""Random forests and boosted trees of many series or folds at once, a task each.

Features are cut into bins at the training rows' quantiles; a tree grows level by level from histograms of
weights and targets by (node, bin).  This is for period-aggregated series, whose rows
a task holds (``GROUP`` at most, which is checked); tables of any length take
:func:`kpi_spark.operators.linear.trees`.  A forest draws Poisson(1) weights for each tree, and its trees see all
features; both models depend on the seed and the rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group, bins of a feature, levels of a forest's and of a boosted tree, share of a boosted tree that counts.
GROUP, BINS, DEPTH, RATE = 1_000_000, 64, {"random_forest": 8, "gradient_boosting": 3}, 0.1


def cuts(x: np.ndarray) -> list[np.ndarray]:
    """Where each feature is cut: midway between neighbouring quantiles of its values."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="inverted_cdf")) if len(column) else np.zeros(0)
        out.append((values[1:] + values[:-1]) / 2)
    return out


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)])


class Tree:
    """A complete binary tree: a feature (-1: none, all rows go left) and a bin for each inner node, a value for each leaf."""

    def __init__(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int) -> None:
        self.splits: list[tuple[np.ndarray, np.ndarray]] = []
        self.gains = np.zeros(codes.shape[1])
        node = np.zeros(len(codes), dtype=np.int64)
        for level in range(depth):
            n = 1 << level
            best, feature, at = np.zeros(n), np.full(n, -1), np.zeros(n, dtype=np.int64)
            for f in range(codes.shape[1]):
                place = node * BINS + codes[:, f]
                w, g = (np.bincount(place, v, minlength=n * BINS).reshape(n, BINS).cumsum(1) for v in (weight, weight * target))
                left, right, gl, gr = w, w[:, -1:] - w, g, g[:, -1:] - g
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = gl**2 / left + gr**2 / right - g[:, -1:] ** 2 / w[:, -1:]
                gain = np.where((left > 0.5) & (right > 0.5), gain, 0)
                top = gain.argmax(1)
                more = gain[np.arange(n), top] > best + 1e-12 * np.abs(gl[:, -1]).max(initial=0)
                best[more], feature[more], at[more] = gain[np.arange(n), top][more], f, top[more]
            self.splits.append((feature, at))
            np.add.at(self.gains, feature[feature >= 0], best[feature >= 0])
            node = self._down(codes, node, feature, at)
        w, g = (np.bincount(node, v, minlength=1 << depth) for v in (weight, weight * target))
        self.values = np.where(w > 0, g / np.where(w > 0, w, 1), 0)

    @staticmethod
    def _down(codes: np.ndarray, node: np.ndarray, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        f = feature[node]
        return 2 * node + ((f >= 0) & (codes[np.arange(len(codes)), np.maximum(f, 0)] > at[node]))

    def predict(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), dtype=np.int64)
        for feature, at in self.splits:
            node = self._down(codes, node, feature, at)
        return self.values[node]


class Ensemble:
    """A fitted model of complete rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, model: str, trees: int, seed: int) -> None:
        self.edges, self.base, self.rate = cuts(x), 0.0, 1.0 / trees
        codes, depth, random, self.trees = coded(x, self.edges), DEPTH[model], np.random.default_rng(seed), []
        if model == "random_forest":
            for _ in range(trees):
                weight = random.poisson(1.0, len(y)).astype(float)
                self.trees.append(Tree(codes, y, weight if weight.any() else np.ones(len(y)), depth))
        else:
            self.base, self.rate = float(y.mean()), RATE
            rest = y - self.base
            for _ in range(trees):
                tree = Tree(codes, rest, np.ones(len(y)), depth)
                rest = rest - self.rate * tree.predict(codes)
                self.trees.append(tree)

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = coded(x, self.edges)
        return self.base + self.rate * np.sum([t.predict(codes) for t in self.trees], axis=0)

    @property
    def importances(self) -> np.ndarray:
        """Each feature's share of what all splits gain."""
        total = np.sum([t.gains for t in self.trees], axis=0)
        return total / total.sum() if total.sum() > 0 else total


def _checked(df: DataFrame, by: Sequence[str]) -> None:
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > GROUP:
        raise ValueError(f"a group has {most} rows, over {GROUP}; use linear.trees")


def importances(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), model: str = "gradient_boosting", trees: int = 300, seed: int = 42) -> DataFrame:
    """(by, term, importance) of one model a group, over complete rows."""
    xs, by = list(xs), list(by)
    rows = df.dropna(subset=[*xs, y]).select(*by, *(F.col(c).cast("double").alias(c) for c in [*xs, y]))
    _checked(rows, by)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        made = Ensemble(frame[xs].to_numpy(float), frame[y].to_numpy(float), model, trees, seed)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * len(xs) for c in by}, "term": xs, "importance": made.importances})

    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes)
    return rows.groupBy(*(by or [F.lit(0).alias("_all")])).applyInPandas(run, f"{kinds}term string, importance double")


def validated(folds: DataFrame, xs: Sequence[str], y: str, by: Sequence[str], model: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """Test rows of each fold with ``predicted`` by a model of its train rows and ``baseline``, their mean; all folds in one job, complete rows only."""
    xs, by = list(xs), list(by)
    rows = folds.dropna(subset=[*xs, y])
    _checked(rows, by)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        train, test = frame[~frame["test"].astype(bool)], frame[frame["test"].astype(bool)]
        if not len(train) or not len(test):
            return test.assign(predicted=np.nan, baseline=np.nan).iloc[:0]
        made = Ensemble(train[xs].to_numpy(float), train[y].to_numpy(float), model, trees, seed)
        return test.assign(predicted=made.predict(test[xs].to_numpy(float)), baseline=float(train[y].astype(float).mean()))

    schema = rows.withColumns({"predicted": F.lit(0.0), "baseline": F.lit(0.0)}).schema
    return rows.groupBy(*by).applyInPandas(run, schema)
