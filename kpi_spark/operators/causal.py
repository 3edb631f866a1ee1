"""Campaign impact: control screening, counterfactuals and effects.

All KPIs, targets and control combinations are rows of long tables: one partitioned job,
no loop over models on the driver.  Series are period-aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.functions.distributions import Z95, z_two_sided
from kpi_spark.operators import linear, periods
from kpi_spark.operators.sorting import top_per_group
from kpi_spark.sources.scratch import scratch_path
from kpi_spark.sources.writers import materialise

SHORTLIST, FINALISTS = 12, 5
#: Penalty of the back-test's ridge, on standardised controls.
PENALTY = 1e-3
BANDS = ((0.01, "p<=0.01"), (0.05, "p<=0.05"), (0.10, "p<=0.10"), (0.20, "p<=0.20"))


def check_dates(pre: tuple[str, str], post: tuple[str, str], kpis: Sequence[str], targets: Sequence[str]) -> None:
    """Both spans run forward, the first ends before the second begins, and there is something to measure."""
    if not pre[0] < pre[1] or not post[0] <= post[1] or not pre[1] < post[0]:
        raise ValueError("PRE and POST must each run forward, PRE before POST")
    if not kpis or not targets:
        raise ValueError("at least one KPI and one target are needed")


def by_role(long: DataFrame, target: Column, excluded: Column | None = None, keys: Sequence[str] = ("period",)) -> DataFrame:
    """(keys, target): the summed target; and (keys, series, value) rows of the rest as controls, in one table (role, series, period, value)."""
    rest = ~target if excluded is None else ~target & ~excluded
    role = F.when(target, "target").when(rest, "control")
    return long.withColumn("role", role).where("role is not null").groupBy(*keys, "role", F.when(F.col("role") == "target", "target").otherwise(F.col("series")).alias("series")).agg(F.sum("value").alias("value"))


def split_periods(df: DataFrame, start: str, end: str, pre_start: str | None = None) -> DataFrame:
    """With ``phase``: pre before ``start``, post from it to ``end``."""
    p = F.col("period")
    phase = F.when((p < F.lit(start).cast("date")) & (F.lit(pre_start is None) | (p >= F.lit(pre_start or start).cast("date"))), "pre").when((p >= F.lit(start).cast("date")) & (p <= F.lit(end).cast("date")), "post")
    return df.withColumn("phase", phase).where("phase is not null")


def check_split(split: DataFrame, y: str) -> DataFrame:
    """(pre, post, spread, ok): at least 15 periods before and 1 after, and a target that varies before."""
    pre = F.col("phase") == "pre"
    out = split.agg(F.count_if(pre).alias("pre"), F.count_if(~pre).alias("post"), F.stddev_pop(F.when(pre, F.col(y))).alias("spread"))
    return out.withColumn("ok", (F.col("pre") >= 15) & (F.col("post") >= 1) & (F.coalesce(F.col("spread"), F.lit(0.0)) >= 1e-12))


def paired(roles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, period, series, x, y): each control beside the target."""
    target = roles.where("role = 'target'").select(*keys, "period", F.col("value").alias("y"))
    return roles.where("role = 'control'").select(*keys, "period", "series", F.col("value").alias("x")).join(target, [*keys, "period"])


def screened(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, series, r, reason): controls that can't be used, and why."""
    finite = F.coalesce(F.abs("x") < float("inf"), F.lit(False)) & ~F.isnan("x")
    out = pairs.groupBy(*keys, "series").agg(F.count_if(~finite).alias("bad"), F.stddev_pop(F.when(finite, F.col("x"))).alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop(F.when(finite, F.col("x")), "y").alias("c"))
    reason = F.when(F.col("bad") > 0, "not finite").when(F.coalesce(F.col("sx"), F.lit(0.0)) < 1e-12, "constant")
    return out.select(*keys, "series", F.when(reason.isNull(), F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("r"), reason.alias("reason"))


def backtest_single(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, series, n_test, rmse, baseline_rmse, mae, wape, bias, r2, improvement) of one-control ridge models at the pseudo-cuts."""
    by = [*keys, "series"]
    folds = periods.pseudo_cuts(pairs, by, "period")
    train = folds.where("not test").groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("m"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.covar_pop("x", "y").alias("c"))
    scale = F.when(F.col("sx") < 1e-9, 1.0).otherwise(F.col("sx"))
    slope = (F.col("m") * F.col("c") / scale) / (F.col("m") * F.col("sx") * F.col("sx") / (scale * scale) + PENALTY) / scale
    models = train.select(*by, "fold", slope.alias("b"), "mx", F.col("my").alias("baseline"))
    scored = folds.where("test").join(models, [*by, "fold"]).withColumn("predicted", F.col("baseline") + F.col("b") * (F.col("x") - F.col("mx")))
    return _improved(linear.out_of_sample(scored, "y", "predicted", "baseline", by))


def _improved(tested: DataFrame) -> DataFrame:
    return tested.withColumn("improvement", F.try_divide(F.col("baseline_rmse") - F.col("rmse"), F.col("baseline_rmse")) * 100).drop("quality")


def control_scores(pairs: DataFrame, threshold: float = 0.4, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, series, rmse, stability, spearman, score): relative error, plus penalties for unstable and weak correlation; only controls that beat the mean."""
    by = [*keys, "series"]
    tested = backtest_single(pairs, keys).where("rmse < baseline_rmse")
    stable = periods.correlation_stability(pairs, by, "x", "y", "period")
    ranked = pairs.select(*by, periods.average_rank("x", by).alias("rx"), periods.average_rank("y", by).alias("ry"), "y")
    rank = ranked.groupBy(*by).agg(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("spearman"), F.stddev_pop("y").alias("sy"))
    joined = tested.select(*by, "rmse", "baseline_rmse").join(stable, by).join(rank, by)
    score = F.col("rmse") / F.greatest(F.col("sy"), F.lit(1e-9)) + 0.10 * (1 - F.greatest(F.lit(0.0), F.coalesce("stability", F.lit(-1.0)))) + 0.05 * F.greatest(F.lit(0.0), F.lit(threshold) - F.abs(F.coalesce("spearman", F.lit(0.0))))
    return joined.select(*by, "rmse", "baseline_rmse", "stability", "spearman", score.alias("score"))


def shortlist(scores: DataFrame, keys: Sequence[str] = (), k: int = SHORTLIST) -> DataFrame:
    return top_per_group(scores, keys, F.col("score"), k, "series")


def combinations(short: DataFrame, least: int, most: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, combo: array of series) of every size from ``least`` to ``most``; a shortlist is short by construction."""
    one = short.select(*keys, "series")
    size = one.select(*keys, F.array("series").alias("combo"))
    sizes = {1: size}
    for k in range(2, most + 1):
        longer = sizes[k - 1].join(one, list(keys)) if keys else sizes[k - 1].crossJoin(F.broadcast(one))
        sizes[k] = longer.where(F.element_at("combo", -1) < F.col("series")).select(*keys, F.concat("combo", F.array("series")).alias("combo"))
    out = sizes[least]
    for k in range(least + 1, most + 1):
        out = out.unionByName(sizes[k])
    return out


def design(pairs: DataFrame, combos: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, combo, period, y, xs): the controls of each combination as an array in the combination's order."""
    long = combos.select(*keys, "combo", F.posexplode("combo").alias("place", "series"))
    cells = long.join(pairs, [*keys, "series"]).groupBy(*keys, "combo", "period", "y").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("c"))
    return cells.select(*keys, "combo", "period", "y", F.transform("c", lambda c: c["x"].cast("double")).alias("xs"))


def backtest(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, combo, rmse, baseline_rmse, mae, wape, bias, r2, improvement, score) of ridge models of several controls at the pseudo-cuts.

    One row a period and combination goes in; each combination's folds are solved from the
    cross products of its train rows.
    """
    by = [*keys, "combo"]
    folds = periods.pseudo_cuts(rows, by, "period", F.size("combo"))
    several = folds.groupBy(*by).agg(F.count_distinct("fold").alias("_folds")).where("_folds > 1").select(*by)
    folds = folds.join(several, by, "left_semi")
    cells = F.transform(F.concat("xs", F.array(F.col("y").cast("double"))), lambda v: v)
    wide = folds.withColumn("v", cells)
    # sums and cross products of each fold's train rows, element by element
    terms = wide.where("not test").select(*by, "fold", F.posexplode("v").alias("i", "a"), "v").select(*by, "fold", "i", "a", F.posexplode("v").alias("j", "b")).where("i <= j")
    sums = terms.groupBy(*by, "fold", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.sum("a").alias("t"), F.sum("b").alias("u"), F.count(F.lit(1)).alias("m"))
    packed = sums.groupBy(*by, "fold").agg(F.collect_list(F.struct("i", "j", "s", "t", "u", "m")).alias("g"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in packed.dtypes if c != "g")

    def solve(frames):
        for frame in frames:
            a, b, base = [], [], []
            for g in frame["g"]:
                p = max(x["j"] for x in g) + 1
                raw, mean, m = np.zeros((p, p)), np.zeros(p), g[0]["m"]
                for x in g:
                    raw[x["i"], x["j"]] = raw[x["j"], x["i"]] = x["s"]
                    mean[x["i"]], mean[x["j"]] = x["t"] / m, x["u"] / m
                s = linear.Stats(m, mean, raw - m * np.outer(mean, mean))
                intercept, beta = linear.solve(s, "ridge", PENALTY)
                a.append(intercept)
                b.append(list(map(float, beta)))
                base.append(float(mean[-1]))
            yield frame.drop(columns="g").assign(intercept=a, coefs=b, baseline=base)

    models = packed.mapInPandas(solve, f"{kinds}, intercept double, coefs array<double>, baseline double")
    dot = F.aggregate(F.zip_with("xs", "coefs", lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)
    scored = folds.where("test").join(models, [*by, "fold"]).withColumn("predicted", F.col("intercept") + dot)
    tested = _improved(linear.out_of_sample(scored, "y", "predicted", "baseline", by))
    spread = rows.groupBy(*by).agg(F.stddev_pop("y").alias("_s"))
    return tested.where("rmse < baseline_rmse").join(spread, by).withColumn("score", F.col("rmse") / F.greatest(F.col("_s"), F.lit(1e-9))).drop("_s")


def finalists(tested: DataFrame, keys: Sequence[str] = (), k: int = FINALISTS) -> DataFrame:
    return top_per_group(tested, keys, F.col("score"), k, "combo")


def counterfactual_single(split: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, period, phase, x, y) with ``predicted`` by OLS on the PRE rows, ``se`` and 95 % bounds."""
    pre = split.where("phase = 'pre'")
    models = pre.groupBy(*keys).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.sqrt(F.try_divide(F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x"), F.count(F.lit(1)) - 2)).alias("se"))
    joined = split.join(models, list(keys)) if keys else split.crossJoin(F.broadcast(models))
    out = joined.withColumn("predicted", F.col("a") + F.col("b") * F.col("x"))
    return out.withColumn("low", F.col("predicted") - Z95 * F.col("se")).withColumn("high", F.col("predicted") + Z95 * F.col("se")).drop("a", "b")


def counterfactual(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same for combinations: rows (keys, combo, period, phase, y, xs)."""
    by = [*keys, "combo"]
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("period", "phase", "y", "xs"))).alias("rows"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in packed.dtypes if c != "rows")

    def run(frames):
        for frame in frames:
            predicted, se = [], []
            for rows_ in frame["rows"]:
                x = np.array([[1.0, *r["xs"]] for r in rows_])
                y = np.array([r["y"] for r in rows_], dtype=float)
                pre = np.array([r["phase"] == "pre" for r in rows_])
                beta = np.linalg.lstsq(x[pre], y[pre], rcond=None)[0]
                rest = y[pre] - x[pre] @ beta
                predicted.append(list(map(float, x @ beta)))
                se.append(float(np.sqrt(rest @ rest / max(len(rest) - x.shape[1], 1))))
            yield frame.assign(predicted=predicted, se=se).drop(columns="rows")

    solved = packed.mapInPandas(run, f"{kinds}, predicted array<double>, se double")
    numbered = periods.numbered(rows, by, "period")
    out = numbered.join(solved, by).withColumn("predicted", F.get("predicted", F.col("i").cast("int")))
    return out.withColumn("low", F.col("predicted") - Z95 * F.col("se")).withColumn("high", F.col("predicted") + Z95 * F.col("se")).drop("i", "n")


def effect_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, actual, expected, effect, effect_pct, z, p) over the POST rows; errors of periods are independent."""
    post = scored.where("phase = 'post'")
    sums = post.groupBy(*keys).agg(F.sum("y").alias("actual"), F.sum("predicted").alias("expected"), F.sum(F.col("y") - F.col("predicted")).alias("effect"), (F.max("se") * F.sqrt(F.count(F.lit(1)))).alias("_se"))
    out = sums.withColumn("effect_pct", F.try_divide(F.col("effect"), F.abs("expected")) * 100).withColumn("z", F.try_divide(F.col("effect"), F.col("_se"))).drop("_se")

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(z_two_sided, na_action="ignore")

    return out.withColumn("p", p("z"))


def effect_series(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Effects of each POST period and their running sum, with bounds."""
    run = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = F.col("y") - F.col("predicted")
    post = scored.where("phase = 'post'").withColumn("effect", e)
    total, se = F.sum("effect").over(run), F.sqrt(F.sum(F.col("se") * F.col("se")).over(run))
    return post.select(*keys, "period", "effect", (F.col("effect") - Z95 * F.col("se")).alias("low"), (F.col("effect") + Z95 * F.col("se")).alias("high"), total.alias("cumulative"), (total - Z95 * se).alias("cumulative_low"), (total + Z95 * se).alias("cumulative_high"))


def winners(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The model of least PRE error (rmse, then mae) of each key; POST never decides."""
    window = Window.partitionBy(*keys).orderBy("rmse", "mae", "combo")
    return models.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def significance(p: Column) -> Column:
    out = F.lit("p>0.20")
    for limit, label in reversed(BANDS):
        out = F.when(p <= limit, label).otherwise(out)
    return out


def effect_distribution(effects: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, models, q1, median, q3, significant) of the effects of all combinations."""
    q = lambda x: F.percentile("effect_pct", F.lit(x))
    return effects.groupBy(*keys).agg(F.count(F.lit(1)).alias("models"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.count_if(F.col("p") <= 0.1).alias("significant"))


def executive_table(best: DataFrame, effects: DataFrame, rejected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a KPI and target: effect, percent, p, significance, controls, PRE error and the discarded controls."""
    gone = rejected.where("reason is not null").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s (%s)", "series", "reason"))), ", ").alias("discarded"))
    joined = best.join(effects, [*keys, "combo"]).join(gone, list(keys), "left")
    return joined.select(*keys, "effect", "effect_pct", "p", significance(F.col("p")).alias("significance"), F.array_join("combo", ", ").alias("controls"), "rmse", "improvement", F.when(F.col("p") <= 0.1, "significant").otherwise("not significant").alias("quality"), "discarded", "actual").orderBy(keys[0], F.desc("actual"))


def export_matrix(rows: DataFrame, names: list[str]) -> DataFrame:
    """(period, target, a column for each control)."""
    cells = [F.max(F.when(F.col("series") == n, F.col("x"))).alias(n) for n in names]
    return rows.groupBy("period").agg(F.max("y").alias("target"), *cells)


def analyse(long: DataFrame, targets: dict[str, list[str]], start: str, end: str, least: int = 1, most: int = 3, threshold: float = 0.4) -> dict[str, DataFrame]:
    """Every KPI and target at once: long is (kpi, period, series, value); targets maps a name to the series it sums."""
    spark = long.sparkSession
    names = spark.createDataFrame([(t, s) for t, ss in targets.items() for s in ss], "target string, member string")
    every = spark.createDataFrame([(t,) for t in targets], "target string")
    treated = sorted({s for ss in targets.values() for s in ss})
    keys = ["kpi", "target"]
    ys = long.join(F.broadcast(names), F.col("series") == F.col("member")).groupBy(*keys, "period").agg(F.sum("value").alias("y"))
    xs = long.where(~F.col("series").isin(treated)).crossJoin(F.broadcast(every)).groupBy(*keys, "period", "series").agg(F.sum("value").alias("x"))
    def kept(df: DataFrame, name: str) -> DataFrame:  # period-level tables that several steps read
        return materialise(df, scratch_path(spark, name))

    pairs = kept(split_periods(xs.join(ys, [*keys, "period"]), start, end), "pairs")
    pre = pairs.where("phase = 'pre'").drop("phase")
    rejected = kept(screened(pre, keys), "screened")
    usable = pre.join(rejected.where("reason is null").select(*keys, "series"), [*keys, "series"], "left_semi")
    scores = kept(control_scores(usable, threshold, keys), "scores")
    combos = combinations(shortlist(scores, keys), least, most, keys)
    tested = kept(finalists(backtest(design(usable, combos, keys), keys), keys), "models")
    rows = design(pairs.drop("phase"), tested.select(*keys, "combo"), keys)
    scored = kept(counterfactual(split_periods(rows, start, end), keys), "scored")
    effects = effect_summary(scored, [*keys, "combo"])
    best = winners(tested, keys)
    chosen = scored.join(best.select(*keys, "combo"), [*keys, "combo"], "left_semi")
    return {
        "executive": executive_table(best, effects, rejected, keys),
        "controls": scores,
        "rejected": rejected.where("reason is not null"),
        "models": tested,
        "effects": effects,
        "series": effect_series(chosen, keys),
        "distribution": effect_distribution(effects, keys),
    }
