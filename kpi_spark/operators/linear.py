"""Linear models from sufficient statistics.

:func:`gram` aggregates counts, sums and cross products on Spark (one row a group, with
map-side partial sums); only p x p matrices are solved, on the driver for one model, in
``applyInPandas`` for many.  Rows never leave Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kpi_spark.functions import distributions as dist

MODELS = ("ols", "ridge", "lasso", "elastic_net", "bayesian_ridge", "huber", "random_forest", "gradient_boosting")
LINEAR = ("ols", "ridge", "lasso", "elastic_net", "bayesian_ridge")


def products(xs: Sequence[str], y: str, weight: Column | None = None) -> list[Column]:
    """Aggregates: n, the sums, and the upper triangle of the cross products, x1…xp before y, as one array ``g``."""
    columns = [F.col(c).cast("double") for c in [*xs, y]]
    w = F.lit(1.0) if weight is None else weight
    cells = [F.sum(w), *(F.sum(w * c) for c in columns), *(F.sum(w * columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns)))]
    return [F.array(*cells).alias("g")]


def gram(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """One row a group with its sufficient statistics ``g``."""
    return df.groupBy(*by).agg(*products(xs, y, weight))


@dataclass(frozen=True)
class Stats:
    """Sufficient statistics: n, means, and centred cross products of (x1…xp, y)."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(g: Sequence[float]) -> Stats:
        g = np.asarray(g, dtype=float)
        p = int(round((np.sqrt(9 + 8 * (len(g) - 1)) - 3) / 2))
        n, sums = g[0], g[1 : 1 + p]
        raw = np.zeros((p, p))
        raw[np.triu_indices(p)] = g[1 + p :]
        raw = raw + np.triu(raw, 1).T
        mean = sums / n if n else sums
        return Stats(n, mean, raw - n * np.outer(mean, mean))

    @property
    def scale(self) -> np.ndarray:
        s = np.sqrt(np.maximum(np.diag(self.cross)[:-1] / self.n, 0))
        return np.where(s < 1e-9, 1.0, s)


def solve(stats: Stats, model: str = "ols", alpha: float | None = None, ratio: float = 0.5) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) on the original scale; all but OLS standardise first."""
    xx, xy = stats.cross[:-1, :-1], stats.cross[:-1, -1]
    if model == "ols":
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    else:
        scale = stats.scale
        zz, zy = xx / np.outer(scale, scale), xy / scale
        beta = _regularised(zz, zy, stats, model, alpha, ratio) / scale
    return float(stats.mean[-1] - stats.mean[:-1] @ beta), beta


def _regularised(zz: np.ndarray, zy: np.ndarray, stats: Stats, model: str, alpha: float | None, ratio: float) -> np.ndarray:
    if model == "ridge":
        return np.linalg.solve(zz + (1.0 if alpha is None else alpha) * np.eye(len(zz)), zy)
    if model in ("lasso", "elastic_net"):
        alpha, ratio = 0.01 if alpha is None else alpha, 1.0 if model == "lasso" else ratio
        return _descent(zz / stats.n, zy / stats.n, alpha * ratio, alpha * (1 - ratio))
    if model == "bayesian_ridge":
        return _evidence(zz, zy, stats.cross[-1, -1], stats.n)
    raise ValueError(f"not a linear model: {model}")


def _descent(c: np.ndarray, r: np.ndarray, one: float, two: float) -> np.ndarray:
    """Coordinate descent on covariances, for penalties ``one`` of size and ``two`` of squares."""
    beta = np.zeros(len(r))
    for _ in range(5000):
        before = beta.copy()
        for j in range(len(beta)):
            rest = r[j] - c[j] @ beta + c[j, j] * beta[j]
            beta[j] = np.sign(rest) * max(abs(rest) - one, 0) / (c[j, j] + two) if c[j, j] + two > 0 else 0.0
        if np.abs(beta - before).max(initial=0) < 1e-12:
            break
    return beta


def _evidence(zz: np.ndarray, zy: np.ndarray, yy: float, n: float) -> np.ndarray:
    """Bayesian ridge: noise and weight precisions by evidence maximisation."""
    values, vectors = np.linalg.eigh(zz)
    values, turned = np.maximum(values, 0), vectors.T @ zy
    noise, weight = 1 / max(yy / n, 1e-12), 1.0
    beta = np.zeros(len(zy))
    for _ in range(300):
        before = beta
        inner = turned / (values + weight / noise)
        beta = vectors @ inner
        rss = max(yy - 2 * beta @ zy + beta @ zz @ beta, 0)
        gamma = float(np.sum(noise * values / (weight + noise * values)))
        weight = (gamma + 2e-6) / (float(beta @ beta) + 2e-6)
        noise = (n - gamma + 2e-6) / (rss + 2e-6)
        if np.abs(beta - before).sum() < 1e-10:
            break
    return beta


@dataclass(frozen=True)
class Fit:
    """A fitted linear model and, for OLS, its inference table."""

    xs: tuple[str, ...]
    y: str
    intercept: float
    coefs: tuple[float, ...]
    stats: Stats
    model: str = "ols"

    @property
    def predicted(self) -> Column:
        out = F.lit(self.intercept)
        for name, value in zip(self.xs, self.coefs, strict=True):
            out = out + F.lit(float(value)) * F.col(name)
        return out

    def contributions(self) -> dict[str, Column]:
        """What each predictor and the baseline add to the prediction."""
        return {"baseline": F.lit(self.intercept)} | {x: F.lit(float(b)) * F.col(x) for x, b in zip(self.xs, self.coefs, strict=True)}

    def augmented(self, df: DataFrame) -> DataFrame:
        """The source rows with prediction, residual and contributions."""
        return df.withColumns({"predicted": self.predicted, "residual": F.col(self.y) - self.predicted} | {f"contribution_{x}": c for x, c in self.contributions().items()})

    def inference(self, levels: Sequence[float] = (0.95, 0.90, 0.85)) -> pd.DataFrame:
        """Coefficient, standard error, t, p and intervals of OLS."""
        s, p = self.stats, len(self.xs)
        beta = np.array(self.coefs)
        rss = max(float(s.cross[-1, -1] - beta @ s.cross[:-1, -1]), 0.0)
        freedom = s.n - p - 1
        inverse = np.linalg.pinv(s.cross[:-1, :-1])
        sigma2 = rss / freedom if freedom > 0 else np.nan
        variance = [1 / s.n + s.mean[:-1] @ inverse @ s.mean[:-1], *np.diag(inverse)]
        rows = []
        for name, b, v in zip(("intercept", *self.xs), (self.intercept, *self.coefs), variance, strict=True):
            se = float(np.sqrt(max(sigma2 * v, 0)))
            t = b / se if se else np.inf
            row = {"term": name, "coef": float(b), "se": se, "t": float(t), "p": dist.t_two_sided(float(t), freedom)}
            for level in levels:
                q = dist.t_quantile((1 + level) / 2, freedom)
                row |= {f"low_{round(level * 100)}": b - q * se, f"high_{round(level * 100)}": b + q * se}
            rows.append(row | {"stars": stars(row["p"])})
        return pd.DataFrame(rows)

    def coef_table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.inference() if self.model == "ols" else pd.DataFrame({"term": ["intercept", *self.xs], "coef": [self.intercept, *map(float, self.coefs)]}))


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "." if p < 0.1 else ""


def fit(df: DataFrame, xs: Sequence[str], y: str, model: str = "ols", alpha: float | None = None, ratio: float = 0.5) -> Fit:
    """One linear model over complete rows."""
    xs = tuple(xs)
    if model == "huber":
        return _huber(df, xs, y)
    stats = Stats.of(gram(df.dropna(subset=[*xs, y]), xs, y).first()["g"])
    intercept, beta = solve(stats, model, alpha, ratio)
    return Fit(xs, y, intercept, tuple(map(float, beta)), stats, model)


def _huber(df: DataFrame, xs: tuple[str, ...], y: str, epsilon: float = 1.35) -> Fit:
    rows = df.dropna(subset=[*xs, y])
    made = fit_huber_groups(rows.withColumn("_all", F.lit(0)), xs, y, ["_all"], epsilon).first()
    return Fit(xs, y, float(made["intercept"]), tuple(map(float, made["coefs"])), Stats.of(gram(rows, xs, y).first()["g"]), "huber")


def fit_huber_groups(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str], epsilon: float = 1.35, steps: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """(by, n, intercept, coefs, sigma) of Huber's regression with its scale, of all groups at once.

    Each step is one job for all groups: rows within epsilon * sigma of the last prediction weigh 1, others
    epsilon * sigma / distance; a weighted Gram matrix a group gives the next coefficients, and the rows' distances the
    next sigma.  Steps end when no group's model moves any more.
    """
    from kpi_spark.sources.scratch import scratch_path

    xs, given, spark = list(xs), list(by), df.sparkSession
    by = [f"_by{i}" for i in range(len(given))]  # names of theirs could be those of statistics

    def kept(table: DataFrame) -> DataFrame:
        path = scratch_path(spark, "huber")
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    def stepped(table: DataFrame) -> tuple[DataFrame, float]:
        """The models of a step, written, and how far the farthest of them moved."""
        seen = Observation()
        return kept(table.observe(seen, F.max("moved").alias("most"))), seen.get["most"] or 0.0

    rows = kept(df.dropna(subset=[*xs, y]).select(*(F.col(c).alias(k) for c, k in zip(given, by, strict=True)), *(F.col(c).cast("double").alias(c) for c in [*xs, y])))
    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes)
    schema = f"{kinds}n double, intercept double, coefs array<double>, sigma double, moved double"

    def start(frames):
        for frame in frames:
            made = []
            for g in frame["g"]:
                s = Stats.of(g)
                a, b = solve(s)
                rss = s.cross[-1, -1] - 2 * b @ s.cross[:-1, -1] + b @ s.cross[:-1, :-1] @ b
                made.append((s.n, a, list(map(float, b)), float(np.sqrt(max(rss, 0) / s.n)), np.inf))
            yield frame[by].assign(**{c: [m[i] for m in made] for i, c in enumerate(("n", "intercept", "coefs", "sigma", "moved"))})

    def step(frames):
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                s, old = Stats.of(r.g), np.array(r.coefs, dtype=float)
                a, b = solve(s)
                sigma = float(np.sqrt(max(r.inner, 0) / max(r.rows - epsilon**2 * r.outer, 1e-3 * r.rows)))
                unit = max(sigma, 1e-12 * float(np.abs(s.mean[-1]) + np.sqrt(max(s.cross[-1, -1] / s.n, 0))), 1e-300)
                moved = max(float(np.abs((b - old) * s.scale).max(initial=0)), abs(a + s.mean[:-1] @ b - r.intercept - s.mean[:-1] @ old), abs(sigma - r.sigma)) / unit
                made.append((float(r.rows), a, list(map(float, b)), sigma, moved if sigma > unit * 1e-6 else 0.0))
            yield frame[by].assign(**{c: [m[i] for m in made] for i, c in enumerate(("n", "intercept", "coefs", "sigma", "moved"))})

    models = kept(gram(rows, xs, y, by).mapInPandas(start, schema))
    for _ in range(steps):
        far = F.abs(F.col(y) - predicted_by(xs))
        inside = far <= epsilon * F.col("sigma")
        joined = rows.join(models.drop("n", "moved"), by).withColumns({"_w": F.when(inside, 1.0).otherwise(epsilon * F.col("sigma") / far), "_far": far, "_in": inside})
        stats = joined.groupBy(*by).agg(
            *products(xs, y, F.col("_w")), F.coalesce(F.sum(F.when(F.col("_in"), F.col("_far") * F.col("_far"))), F.lit(0.0)).alias("inner"), F.count_if(~F.col("_in")).alias("outer"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("intercept", "coefs", "sigma"))
        )
        models, most = stepped(stats.mapInPandas(step, schema))
        if most < tolerance:
            break
    return models.drop("moved").withColumnsRenamed(dict(zip(by, given, strict=True)))


def trees(df: DataFrame, xs: Sequence[str], y: str, model: str, trees_: int = 300, seed: int = 42):
    """A forest or boosted trees (Spark ML) over complete rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    ready = VectorAssembler(inputCols=list(xs), outputCol="_features").transform(df.dropna(subset=[*xs, y]))
    kind = RandomForestRegressor(numTrees=trees_, seed=seed) if model == "random_forest" else GBTRegressor(maxIter=trees_, seed=seed)
    return kind.setFeaturesCol("_features").setLabelCol(y).fit(ready)


def importances(df: DataFrame, xs: Sequence[str], y: str, model: str = "random_forest", trees_: int = 300) -> DataFrame:
    values = trees(df, xs, y, model, trees_).featureImportances.toArray()
    return df.sparkSession.createDataFrame([(x, float(v)) for x, v in zip(xs, values, strict=True)], "term string, importance double")


def fit_groups(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str], model: str = "ols", alpha: float | None = None) -> DataFrame:
    """(by, n, intercept, coefs) of one model a group: one shuffle, then a solve for each row of statistics."""
    stats = gram(df.dropna(subset=[*xs, y]), xs, y, by)
    kinds = ", ".join(f"`{c}` {t}" for c, t in stats.dtypes if c != "g")

    def run(frames):
        for frame in frames:
            solved = [(s.n, *solve(s, model, alpha)) for s in map(Stats.of, frame["g"])]
            out = frame.drop(columns="g")
            yield out.assign(n=[s[0] for s in solved], intercept=[s[1] for s in solved], coefs=[list(map(float, s[2])) for s in solved])

    return stats.mapInPandas(run, f"{kinds}, n double, intercept double, coefs array<double>")


def predicted_by(xs: Sequence[str]) -> Column:
    """A prediction from the columns of :func:`fit_groups`."""
    out = F.col("intercept")
    for i, x in enumerate(xs):
        out = out + F.get(F.col("coefs"), F.lit(i)) * F.col(x)
    return out


def bootstrap(df: DataFrame, xs: Sequence[str], y: str, key: str, model: str = "ols", replicates: int = 300, level: float = 0.95) -> DataFrame:
    """(term, low, median, high, se): Poisson(1) weights by a hash of each row's key and the replicate, so results don't depend on how rows are dealt.

    Weights are drawn inside the tasks: a partition's rows become one set of sufficient statistics a
    replicate, by a product of weights and cross products, and only these are shuffled.
    """
    names, columns = ["intercept", *xs], [*xs, y]
    upper = np.triu_indices(len(columns))
    mass = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 9)]))  # of up to 8

    def drawn(batches):
        size, total = 1 + len(columns) + len(upper[0]), None
        for batch in batches:
            h = batch.column("_h").to_numpy(zero_copy_only=False).view(np.uint64)
            z = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            cells = np.column_stack([np.ones(len(z)), z, z[:, upper[0]] * z[:, upper[1]]])
            for i in range(0, len(z), 4096):
                u = _mixed(h[i : i + 4096, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                weight = np.searchsorted(mass, (u >> np.uint64(11)) / float(1 << 53), "right").astype(float)
                total = (np.zeros((replicates, size)) if total is None else total) + weight.T @ cells[i : i + 4096]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["rep", "g"])

    rows = df.dropna(subset=[*xs, y]).select(F.xxhash64(F.col(key), F.lit(42)).alias("_h"), *(F.col(c).cast("double").alias(c) for c in columns))
    parts = rows.mapInArrow(drawn, "rep int, g array<double>")
    n = 1 + len(columns) + len(upper[0])
    stats = parts.groupBy("rep").agg(F.array(*(F.sum(F.get("g", F.lit(i))) for i in range(n))).alias("g"))

    def run(frames):
        for frame in frames:
            out = []
            for rep, g in zip(frame["rep"], frame["g"], strict=True):
                if g[0] > 0:
                    a, b = solve(Stats.of(g), model)
                    out += [(rep, t, float(v)) for t, v in zip(names, (a, *b), strict=True)]
            yield pd.DataFrame(out, columns=["rep", "term", "coef"])

    solved = stats.mapInPandas(run, "rep int, term string, coef double")
    q = lambda p: F.percentile("coef", F.lit(p))
    return solved.groupBy("term").agg(q((1 - level) / 2).alias("low"), q(0.5).alias("median"), q((1 + level) / 2).alias("high"), F.stddev_samp("coef").alias("se"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- metrics -----------------------------------------------------------------------------


def fit_metrics(scored: DataFrame, y: str, predicted: str, predictors: int) -> DataFrame:
    """n, p, R², adjusted R², RMSE, MAE, MAPE, sMAPE, residual deviation, AIC and BIC of predictions."""
    a, f = F.col(y).cast("double"), F.col(predicted).cast("double")
    e = a - f
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("rss"),
        (F.var_pop(a) * F.count(a)).alias("tss"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(F.abs(a) >= 1e-9, F.abs(e / F.nullif(a, F.lit(0.0))))) * 100).alias("mape"),
        (F.avg(F.when(F.abs(a) + F.abs(f) >= 1e-9, 2 * F.abs(e) / F.nullif(F.abs(a) + F.abs(f), F.lit(0.0)))) * 100).alias("smape"),
        F.stddev_samp(e).alias("residual_std"),
    )
    r2 = 1 - F.try_divide(F.col("rss"), F.col("tss"))
    k, n = F.lit(predictors + 1), F.col("n")
    loglik = -0.5 * n * (F.ln(F.lit(2 * np.pi) * F.col("rss") / n) + 1)
    return sums.select(
        "n",
        F.lit(predictors).alias("predictors"),
        r2.alias("r2"),
        (1 - (1 - r2) * F.try_divide((n - 1).cast("double"), n - predictors - 1)).alias("adjusted_r2"),
        F.sqrt(F.col("rss") / n).alias("rmse"),
        "mae",
        "mape",
        "smape",
        "residual_std",
        F.when(F.col("rss") > 0, 2 * k - 2 * loglik).alias("aic"),
        F.when(F.col("rss") > 0, k * F.ln(n) - 2 * loglik).alias("bic"),
    )


def durbin_watson(residuals: DataFrame, e: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    from pyspark.sql import Window

    step = F.col(e) - F.lag(e).over(Window.partitionBy(*by).orderBy(order))
    rows = residuals.withColumn("_d", step)
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col(e) * F.col(e))).alias("durbin_watson"))


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the greatest value, empty ones too; the greatest is in the last one."""
    v = F.col(column).cast("double")
    span = rows.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")).where("_lo is not null").withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(v - F.col("_lo"), F.col("_w"))), F.lit(0))).cast("int")
    counts = rows.where(v.isNotNull()).crossJoin(F.broadcast(span)).groupBy(place.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    grid = span.select("_lo", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    joined = grid.join(counts, F.col("bin") == F.col("_bin"), "left")
    return joined.select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), F.coalesce("_n", F.lit(0)).alias("n"))


def residual_quantiles(scored: DataFrame, column: str = "residual") -> DataFrame:
    """(column, p, normal): every value in order beside its plotting position (i - 0.5) / n and the normal quantile of that.

    Places come from the ranged counts of :mod:`kpi_spark.operators.ranking`; equal values take neighbouring places.
    """
    from kpi_spark.operators.ranking import value_counts

    counts = value_counts(scored, column)
    placed = counts.select(F.col("value").alias(column), F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("_i"), "total")
    p = (F.col("_i") - 0.5) / F.col("total")
    return placed.select(column, p.alias("p"), dist.normal_quantile(p).alias("normal"))


def out_of_sample(scored: DataFrame, y: str, predicted: str, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, baseline_rmse, mae, wape, bias, r2 of test rows, and whether the baseline is beaten."""
    e, b = F.col(y) - F.col(predicted), F.col(y) - F.col(baseline)
    out = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.avg(b * b)).alias("baseline_rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(y))) * 100).alias("wape"),
        F.avg(e).alias("bias"),
        F.when(F.var_pop(y) > 1e-12, 1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )
    return out.withColumn("quality", F.when(F.col("rmse") < F.col("baseline_rmse"), "medium").otherwise("low"))


def validated(folds: DataFrame, xs: Sequence[str], y: str, by: Sequence[str], model: str = "ols", alpha: float | None = None) -> DataFrame:
    """Test rows of each fold with ``predicted`` by a model of its train rows and ``baseline``, their mean.

    All folds of a model are fitted by the same jobs: linear ones from one Gram matrix a fold, Huber's by steps over all
    folds, the trees a task a fold (see :mod:`kpi_spark.operators.trees`).
    """
    by = list(by)
    if model not in (*LINEAR, "huber"):
        from kpi_spark.operators import trees as series_trees

        return series_trees.validated(folds, xs, y, by, model)
    train = folds.where("not test")
    models = fit_huber_groups(train, xs, y, by).drop("sigma") if model == "huber" else fit_groups(train, xs, y, by, model, alpha)
    means = train.groupBy(*by).agg(F.avg(y).alias("baseline"))
    return folds.where("test").join(models.join(means, by), by).withColumn("predicted", predicted_by(xs)).drop("n", "intercept", "coefs")


def compare_models(folds: DataFrame, xs: Sequence[str], y: str, models: Sequence[str] = ("ols", "ridge", "elastic_net", "huber", "random_forest", "gradient_boosting")) -> DataFrame:
    """(model, complexity, rmse, baseline_rmse, candidate) of each model on the same folds."""
    parts = [out_of_sample(validated(folds, xs, y, ["fold"], m), y, "predicted", "baseline").select(F.lit(m).alias("model"), F.lit(k).alias("complexity"), "rmse", "baseline_rmse") for k, m in enumerate(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("candidate", F.col("rmse") < F.col("baseline_rmse"))


def choose_model(compared: DataFrame) -> str:
    """The simplest model within 2 percent of the best that beats the baseline."""
    from kpi_spark.operators.sorting import simplest_near_best

    row = simplest_near_best(compared.where("candidate"), "rmse", "complexity").first()
    if row is None:
        raise ValueError("no model beats the mean of the training rows")
    return row["model"]


def contribution_ranking(augmented: DataFrame, fit_: Fit) -> DataFrame:
    """(term, total, absolute, mean, share, sign) of each contribution; share: percent of the summed size of predictions."""
    terms = ["baseline", *fit_.xs]
    size = F.sum(F.abs("predicted"))
    wide = augmented.agg(size.alias("_size"), *(F.struct(F.sum(f"contribution_{t}").alias("total"), F.sum(F.abs(f"contribution_{t}")).alias("absolute"), F.avg(f"contribution_{t}").alias("mean")).alias(f"c{i}") for i, t in enumerate(terms)))
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"c{i}").alias("c")) for i, t in enumerate(terms)))
    out = wide.select("_size", F.explode(rows).alias("r")).select("r.term", "r.c.*", "_size")
    return out.select("term", "total", "absolute", "mean", (F.try_divide(F.col("absolute"), F.col("_size")) * 100).alias("share"), F.when(F.col("total") >= 0, "+").otherwise("-").alias("sign")).orderBy(F.desc("absolute"))


def preflight(df: DataFrame, xs: Sequence[str], y: str, events: Sequence[str] = ()) -> DataFrame:
    """(level, column, finding) about a model's data, from one pass and the VIFs."""
    from kpi_spark.operators.corr import vif

    n = F.count(F.lit(1))
    row = df.agg(n.alias("n"), *(F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.stddev_pop(c).alias("s")).alias(f"c{i}") for i, c in enumerate([y, *xs])), *(F.avg((F.coalesce(F.col(e), F.lit(0)) > 0).cast("double")).alias(f"e{i}") for i, e in enumerate(events))).first()
    out: list[tuple[str, str, str]] = []
    if row["n"] < 100:
        out.append(("error" if row["n"] < 30 else "warning", "", f"{row['n']} rows"))
    good = []
    for i, c in enumerate([y, *xs]):
        cell = row[f"c{i}"]
        if not cell["s"]:
            out.append(("error", c, "constant"))
        elif c != y:
            good.append(c)
        if row["n"] and cell["nulls"] > 0.2 * row["n"]:
            out.append(("warning", c, f"{100 * cell['nulls'] / row['n']:.0f} % null"))
    if len(good) > 1:
        out += [("error" if r["vif"] > 20 else "warning", r["column"], f"VIF {r['vif']:.1f}") for r in vif(df, good).collect() if r["vif"] > 10]
    out += [("warning", e, "the event covers over 40 % of the rows") for i, e in enumerate(events) if (row[f"e{i}"] or 0) > 0.4]
    return df.sparkSession.createDataFrame(out, "level string, column string, finding string")


