"""Queries on correlation, regression, interrupted series and campaign impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpi_spark.operators import causal, corr, its, linear, periods, preparation, trees
from kpi_spark.plans.base import query, rounded, two
from kpi_spark.sources.scratch import scratch_path
from kpi_spark.sources.writers import materialise

_LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("m01_corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 3) + 0.0 AS r FROM lineitem" for i, a in enumerate(_LINES) for b in _LINES[i + 1 :]))
def _(spark, table):
    return corr.pairs(table("lineitem"), _LINES)


@query("m01_strong_pairs", "SELECT 'l_quantity' AS x, 'gross' AS y, round(corr(l_quantity, l_quantity * 2 + l_tax), 3) AS r FROM lineitem")
def _(spark, table):
    rows = table("lineitem").withColumn("gross", F.col("l_quantity") * 2 + F.col("l_tax"))
    return corr.strong(corr.pairs(rows, ["l_quantity", "gross", "l_discount"]))


@query(
    "m02_spearman",
    "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT 'p_size' AS x, 'p_retailprice' AS y, round(corr(a, b), 3) AS r FROM r",
)
def _(spark, table):
    return corr.by_method(table("part"), ["p_size", "p_retailprice"], "spearman")


_MONTHS = "SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS y, count(*)::DOUBLE AS x1, count(DISTINCT o_custkey)::DOUBLE AS x2 FROM orders GROUP BY 1"


def _months(table):
    return table("orders").groupBy(periods.period("o_orderdate", "M").alias("period")).agg(F.sum("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("x1"), F.count_distinct("o_custkey").cast("double").alias("x2"))


@query(
    "m02_kendall",
    f"WITH m AS (SELECT row_number() OVER (ORDER BY period) AS i, x1, y FROM ({_MONTHS})), s AS (SELECT sign(a.x1 - b.x1) AS p, sign(a.y - b.y) AS q FROM m a JOIN m b ON a.i < b.i) SELECT 'x1' AS x, 'y' AS y, round(sum(p * q) / sqrt(sum(abs(p)) * sum(abs(q))), 3) AS r FROM s",
)
def _(spark, table):
    return corr.by_method(_months(table), ["x1", "y"], "kendall")


@query(
    "m02_kendall_lines",
    """WITH c AS (SELECT l_quantity AS x, l_tax AS y, count(*)::HUGEINT AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS n FROM c),
        p AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM c AS a JOIN c AS b ON a.x < b.x), tx AS (SELECT sum(n * (n - 1)) / 2 AS t FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1)) / 2 AS t FROM (SELECT sum(n) AS n FROM c GROUP BY y))
        SELECT 'l_quantity' AS x, 'l_tax' AS y, round(s / sqrt((t.n * (t.n - 1) / 2 - tx.t)::DOUBLE * (t.n * (t.n - 1) / 2 - ty.t)::DOUBLE), 6) AS r FROM p, t, tx, ty""",
)
def _(spark, table):
    """Every line, with very many ties."""
    return corr.by_method(table("lineitem"), ["l_quantity", "l_tax"], "kendall", digits=6)


@query("m03_corr_with_target", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def _(spark, table):
    return rounded(corr.with_target(table("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 6, "r")


@query("m04_vif", "SELECT 'l_quantity' AS \"column\", round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 6) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 6) FROM lineitem")
def _(spark, table):
    return rounded(corr.vif(table("lineitem"), ["l_quantity", "l_extendedprice"]), 6, "vif")


@query("m05_preflight")
def _(spark, table):
    return linear.preflight(table("lineitem").withColumn("twice", F.col("l_quantity") * 2), ["l_quantity", "twice", "l_tax"], "l_extendedprice")


@query(
    "m06_ols_simple",
    "WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy, count(*) AS n, avg(l_quantity) AS mx FROM lineitem), e AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s) SELECT 'intercept' AS term, round(a, 3) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 3) AS se FROM e UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(s2 / sxx), 3) FROM e",
)
def _(spark, table):
    rows = table("lineitem")
    return rounded(linear.fit(rows, ["l_quantity"], "l_extendedprice").coef_table(rows).select("term", "coef", "se"), 3, "coef", "se")


def _regularised(name, model):
    @query(name)
    def _(spark, table):
        months = _months(table)
        return linear.fit(months, ["x1", "x2"], "y", model).coef_table(months)


@query(
    "m07_ridge_rounded",
    f"""WITH s AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS r, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM ({_MONTHS})),
        b AS (SELECT *, ((n + 1) * n * c1 / s1 - n * r * n * c2 / s2) / ((n + 1) ** 2 - (n * r) ** 2) / s1 AS b1, ((n + 1) * n * c2 / s2 - n * r * n * c1 / s1) / ((n + 1) ** 2 - (n * r) ** 2) / s2 AS b2 FROM s)
        SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 2) AS coef FROM b UNION ALL SELECT 'x1', round(b1, 3) FROM b UNION ALL SELECT 'x2', round(b2, 3) FROM b""",
)
def _(spark, table):
    """Ridge of two standardised predictors, by its closed form."""
    months = _months(table)
    made = linear.fit(months, ["x1", "x2"], "y", "ridge").coef_table(months)
    return made.withColumn("coef", F.when(F.col("term") == "intercept", F.round("coef", 2)).otherwise(F.round("coef", 3)))


for _name, _model in (("m07_ridge", "ridge"), ("m08_lasso", "lasso"), ("m09_elastic_net", "elastic_net"), ("m10_bayesian_ridge", "bayesian_ridge"), ("m11_huber", "huber")):
    _regularised(_name, _model)


def _shrunk(name, model, one, two):
    @query(
        name,
        f"""WITH s AS (SELECT avg(x1) AS mx, avg(y) AS my, stddev_pop(x1) AS sx, covar_pop(x1, y) / stddev_pop(x1) AS r FROM ({_MONTHS})), b AS (SELECT *, sign(r) * greatest(abs(r) - {one}, 0) / (1 + {two}) / sx AS b FROM s)
            SELECT 'intercept' AS term, round(my - b * mx, 2) AS coef FROM b UNION ALL SELECT 'x1', round(b, 4) FROM b""",
    )
    def _(spark, table):
        """One standardised predictor: soft thresholding."""
        months = _months(table)
        made = linear.fit(months, ["x1"], "y", model).coef_table(months)
        return made.withColumn("coef", F.when(F.col("term") == "intercept", F.round("coef", 2)).otherwise(F.round("coef", 4)))


_shrunk("m08_lasso_one", "lasso", 0.01, 0.0)
_shrunk("m09_elastic_net_one", "elastic_net", 0.005, 0.005)


@query("m12_random_forest")
def _(spark, table):
    return linear.importances(_months(table), ["x1", "x2"], "y", "random_forest", 300)


@query("m13_gradient_boosting")
def _(spark, table):
    return trees.importances(_months(table), ["x1", "x2"], "y", trees=300)


@query("m15_bootstrap")
def _(spark, table):
    return linear.bootstrap(_months(table), ["x1"], "y", "period", replicates=500)


_OLS = f"WITH m AS ({_MONTHS}), f AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM m), s AS (SELECT m.*, a, b, a + b * x1 AS f FROM m, f)"


@query("m16_contributions", f"{_OLS} SELECT period, round(a, 2) AS contribution_baseline, round(b * x1, 2) AS contribution_x1, round(f, 2) AS predicted, round(y - f, 2) AS residual FROM s")
def _(spark, table):
    months = _months(table)
    made = linear.fit(months, ["x1"], "y").augmented(months)
    names = ["contribution_baseline", "contribution_x1", "predicted", "residual"]
    return rounded(made.select("period", *names), 2, *names)


@query("m17_contribution_ranking", f"{_OLS} SELECT 'baseline' AS term, round(sum(a), 1) AS total, round(sum(abs(a)) / sum(abs(f)) * 100, 6) AS share FROM s UNION ALL SELECT 'x1', round(sum(b * x1), 1), round(sum(abs(b * x1)) / sum(abs(f)) * 100, 6) FROM s")
def _(spark, table):
    months = _months(table)
    model = linear.fit(months, ["x1"], "y")
    made = linear.contribution_ranking(model.augmented(months), model)
    return rounded(rounded(made.select("term", "total", "share"), 1, "total"), 6, "share")


@query(
    "m18_fit_metrics",
    f"""{_OLS}, z AS (SELECT count(*) AS n, sum((y - f) ** 2) AS rss, sum((y - (SELECT avg(y) FROM m)) ** 2) AS tss, avg(abs(y - f)) AS mae, avg(abs((y - f) / y)) * 100 AS mape, stddev_samp(y - f) AS sd FROM s)
        SELECT n, round(1 - rss / tss, 6) AS r2, round(1 - (rss / tss) * (n - 1) / (n - 2), 6) AS adjusted_r2, round(sqrt(rss / n), 3) AS rmse, round(mae, 3) AS mae, round(mape, 6) AS mape, round(sd, 3) AS residual_std, round(4 + n * (ln(2 * pi() * rss / n) + 1), 4) AS aic, round(2 * ln(n) + n * (ln(2 * pi() * rss / n) + 1), 4) AS bic FROM z""",
)
def _(spark, table):
    months = _months(table)
    made = linear.fit_metrics(linear.fit(months, ["x1"], "y").augmented(months), "y", "predicted", 1)
    out = rounded(made.drop("predictors", "smape"), 6, "r2", "adjusted_r2", "mape")
    return rounded(rounded(out, 3, "rmse", "mae", "residual_std"), 4, "aic", "bic")


@query("w05_durbin_watson", f"{_OLS}, d AS (SELECT y - f AS e, (y - f) - lag(y - f) OVER (ORDER BY period) AS d FROM s) SELECT round(sum(d ** 2) / sum(e ** 2), 6) AS durbin_watson FROM d")
def _(spark, table):
    months = _months(table)
    return rounded(linear.durbin_watson(linear.fit(months, ["x1"], "y").augmented(months), "residual", "period"), 6, "durbin_watson")


@query("w14_residual_histogram", f"{_OLS}, e AS (SELECT y - f AS e FROM s), r AS (SELECT min(e) AS lo, max(e) AS hi FROM e), b AS (SELECT least(29, floor((e - lo) / ((hi - lo) / 30)))::INT AS bin FROM e, r) SELECT g.bin::INT AS bin, count(b.bin) AS n FROM range(30) AS g(bin) LEFT JOIN b ON b.bin = g.bin GROUP BY 1")
def _(spark, table):
    months = _months(table)
    return linear.histogram(linear.fit(months, ["x1"], "y").augmented(months), "residual").select("bin", "n")


@query("w14_residual_positions", f"{_OLS} SELECT round(y - f, 3) AS residual, round((row_number() OVER (ORDER BY y - f) - 0.5) / count(*) OVER (), 9) AS p FROM s")
def _(spark, table):
    months = _months(table)
    made = linear.residual_quantiles(linear.fit(months, ["x1"], "y").augmented(months))
    return rounded(rounded(made.select("residual", "p"), 3, "residual"), 9, "p")


@query("w14_residual_quantiles")
def _(spark, table):
    """Residuals in order beside their plotting positions and the normal quantiles of these."""
    months = _months(table)
    return linear.residual_quantiles(linear.fit(months, ["x1"], "y").augmented(months))


_TWO = f"""WITH m AS ({_MONTHS}), s AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y, count(*) * var_pop(y) AS syy FROM m),
        d AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
        v AS (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM d)"""


@query(
    "m19_coefficients",
    f"""{_TWO}, t AS (SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 AS coef, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS se FROM v UNION ALL SELECT 'x1', b1, sqrt(s2 * s22 / det) FROM v UNION ALL SELECT 'x2', b2, sqrt(s2 * s11 / det) FROM v)
        SELECT term, round(coef, 2) AS coef, round(se, 2) AS se, round(coef / se, 5) AS t FROM t""",
)
def _(spark, table):
    """Two predictors, by the closed form of their normal equations."""
    months = _months(table)
    made = linear.fit(months, ["x1", "x2"], "y").coef_table(months).select("term", "coef", "se", "t")
    return rounded(rounded(made, 2, "coef", "se"), 5, "t")


@query("m19_coef_table")
def _(spark, table):
    months = _months(table)
    return linear.fit(months, ["x1", "x2"], "y").coef_table(months)


@query(
    "m20_holdout",
    f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM ({_MONTHS})), c AS (SELECT *, i > n - greatest(2, ceil(n * 0.2)::BIGINT) AS test FROM m), f AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, avg(y) AS mean FROM c WHERE NOT test), s AS (SELECT y, a + b * x1 AS f, mean FROM c, f WHERE test)
        SELECT count(*) AS n_test, round(sqrt(avg((y - f) ** 2)), 3) AS rmse, round(sqrt(avg((y - mean) ** 2)), 3) AS baseline_rmse, round(avg(abs(y - f)), 3) AS mae, round(sum(abs(y - f)) / sum(abs(y)) * 100, 6) AS wape, round(avg(y - f), 3) AS bias FROM s""",
)
def _(spark, table):
    rows = periods.holdout(_months(table), [], "period").withColumn("fold", F.lit(1))
    made = linear.out_of_sample(linear.validated(rows, ["x1"], "y", ["fold"]), "y", "predicted", "baseline").drop("r2", "quality")
    return rounded(rounded(made, 3, "rmse", "baseline_rmse", "mae", "bias"), 6, "wape")


@query(
    "m21_rolling_ols",
    f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM ({_MONTHS})), k AS (SELECT *, (SELECT max(k) FROM range(2, 6) t(k) WHERE n // (k + 1) >= 10 AND k <= n - 1) AS folds FROM m), g AS (SELECT *, unnest(range(1, folds + 1)) AS fold FROM k), c AS (SELECT *, n - (folds - fold + 1) * (n // (folds + 1)) AS cut, n // (folds + 1) AS size FROM g),
        f AS (SELECT fold, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, avg(y) AS mean FROM c WHERE i < cut GROUP BY 1), s AS (SELECT c.fold, y, a + b * x1 AS f, mean FROM c JOIN f USING (fold) WHERE i >= cut AND i < cut + size)
        SELECT count(*) AS n_test, round(sqrt(avg((y - f) ** 2)), 3) AS rmse, round(sqrt(avg((y - mean) ** 2)), 3) AS baseline_rmse, round(avg(y - f), 3) AS bias FROM s""",
)
def _(spark, table):
    folds = periods.expanding_folds(_months(table), [], "period", 1)
    made = linear.out_of_sample(linear.validated(folds, ["x1"], "y", ["fold"]), "y", "predicted", "baseline")
    return rounded(made.select("n_test", "rmse", "baseline_rmse", "bias"), 3, "rmse", "baseline_rmse", "bias")


@query("m22_model_comparison")
def _(spark, table):
    folds = periods.expanding_folds(_months(table), [], "period", 2)
    compared = materialise(linear.compare_models(folds, ["x1", "x2"], "y"), scratch_path(spark, "compared"))
    return compared.withColumn("chosen", F.col("model") == linear.choose_model(compared))


def _its(table):
    weekly = periods.aggregate(table("orders"), "o_orderdate", "W", ["o_totalprice"])
    return its.fit(weekly.withColumn("event", (F.col("period") >= F.lit("2000-01-03").cast("date")).cast("int")), "period", "o_totalprice", "event")


@query("m23_its_coefficients")
def _(spark, table):
    return _its(table).coefficients()


_LINES_OF_ITS = """WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS period, sum(o_totalprice) AS y FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS t FROM w), b AS (SELECT min(t) AS start FROM r WHERE period >= DATE '2000-01-03'),
        c AS (SELECT regr_intercept(y, t) FILTER (t < start) AS a0, regr_slope(y, t) FILTER (t < start) AS b0, regr_intercept(y, t) FILTER (t >= start) AS a1, regr_slope(y, t) FILTER (t >= start) AS b1 FROM r, b),
        e AS (SELECT period, (a1 + b1 * t) - (a0 + b0 * t) AS effect FROM r, b, c WHERE t >= start)"""


@query("m23_its_effect_points", f"{_LINES_OF_ITS} SELECT period, round(effect, 0) AS effect, round(sum(effect) OVER (ORDER BY period), 0) AS cumulative FROM e")
def _(spark, table):
    """A level and a slope change are the difference of two lines."""
    return rounded(_its(table).effects().select("period", "effect", "cumulative"), 0, "effect", "cumulative")


@query(
    "m24_augmented",
    f"{_LINES_OF_ITS}, x AS (SELECT date_trunc('week', o_orderdate)::DATE AS period, count(*)::DOUBLE AS n, sum(o_totalprice) AS o_totalprice FROM orders GROUP BY 1), f AS (SELECT regr_slope(o_totalprice, n) AS b, regr_intercept(o_totalprice, n) AS a FROM x) SELECT x.period, round(a + b * n, 2) AS predicted, round(o_totalprice - a - b * n, 2) AS residual, round(b * n, 2) AS contribution_n, round(effect, 0) AS event_effect FROM x CROSS JOIN f LEFT JOIN e ON e.period = x.period",
)
def _(spark, table):
    """Prediction, residual and contributions beside the effect of an event."""
    weekly = table("orders").groupBy(periods.period("o_orderdate", "W").alias("period")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("o_totalprice"))
    made = preparation.with_event_effect(linear.fit(weekly, ["n"], "o_totalprice"), weekly, _its(table), "period")
    return rounded(rounded(made.select("period", "predicted", "residual", "contribution_n", "event_effect"), 2, "predicted", "residual", "contribution_n"), 0, "event_effect")


def _its_groups(table):
    weekly = periods.aggregate(table("orders"), "o_orderdate", "W", ["o_totalprice"], ["o_orderpriority"])
    return its.fit_groups(weekly.withColumn("event", (F.col("period") >= F.lit("2000-01-03").cast("date")).cast("int")), "period", "o_totalprice", "event", ["o_orderpriority"])


_LINES_OF_GROUPS = """WITH w AS (SELECT o_orderpriority, date_trunc('week', o_orderdate)::DATE AS period, sum(o_totalprice) AS y FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) - 1 AS t FROM w), b AS (SELECT o_orderpriority, min(t) AS start FROM r WHERE period >= DATE '2000-01-03' GROUP BY 1),
        c AS (SELECT o_orderpriority, max(start) AS start, regr_intercept(y, t) FILTER (t < start) AS a0, regr_slope(y, t) FILTER (t < start) AS b0, regr_intercept(y, t) FILTER (t >= start) AS a1, regr_slope(y, t) FILTER (t >= start) AS b1 FROM r JOIN b USING (o_orderpriority) GROUP BY 1)"""


@query("m23_its_by_priority", f"{_LINES_OF_GROUPS} SELECT o_orderpriority, term, round(coef, 1) AS coef FROM (SELECT o_orderpriority, unnest(['const', 'trend', 'level_change', 'slope_change']) AS term, unnest([a0, b0, (a1 + b1 * start) - (a0 + b0 * start), b1 - b0]) AS coef FROM c)")
def _(spark, table):
    """One interrupted series a priority, all fitted at once."""
    return rounded(_its_groups(table).coefficients().select("o_orderpriority", "term", "coef"), 1, "coef")


@query("m23_its_effects_by_priority", f"{_LINES_OF_GROUPS} SELECT o_orderpriority, period, round((a1 + b1 * t) - (a0 + b0 * t), 0) AS effect, round(sum((a1 + b1 * t) - (a0 + b0 * t)) OVER (PARTITION BY o_orderpriority ORDER BY period), 0) AS cumulative FROM r JOIN c USING (o_orderpriority) WHERE t >= start")
def _(spark, table):
    return rounded(_its_groups(table).effects().select("o_orderpriority", "period", "effect", "cumulative"), 0, "effect", "cumulative")


@query("m23_its_effects")
def _(spark, table):
    return _its(table).effects()


# -- campaign impact: weekly revenue by priority, campaign from 2000 on -------------------

_START, _END = "2000-01-03", "2000-06-26"
_WEEKS = "SELECT date_trunc('week', o_orderdate)::DATE AS period, o_orderpriority AS series, sum(o_totalprice) AS value FROM orders GROUP BY ALL"
_BESIDE = f"WITH w AS ({_WEEKS}), t AS (SELECT period, sum(value) AS y FROM w WHERE series = '1-URGENT' GROUP BY 1), p AS (SELECT period, series, value AS x, y FROM w JOIN t USING (period) WHERE series <> '1-URGENT')"
_SPLIT = f"{_BESIDE}, s AS (SELECT *, CASE WHEN period < DATE '{_START}' THEN 'pre' WHEN period <= DATE '{_END}' THEN 'post' END AS phase FROM p WHERE period <= DATE '{_END}')"


def _weeks(table):
    return periods.aggregate(table("orders"), "o_orderdate", "W", ["o_totalprice"], ["o_orderpriority"]).select("period", F.col("o_orderpriority").alias("series"), F.col("o_totalprice").alias("value"))


def _roles(table):
    return causal.by_role(_weeks(table), F.col("series") == "1-URGENT")


def _split(table):
    return causal.split_periods(causal.paired(_roles(table)), _START, _END)


@query("c01_target_controls", f"SELECT period, CASE WHEN series = '1-URGENT' THEN 'target' ELSE 'control' END AS role, CASE WHEN series = '1-URGENT' THEN 'target' ELSE series END AS series, round(value, 2) AS value FROM ({_WEEKS})")
def _(spark, table):
    return rounded(_roles(table), 2, "value")


@query("c02_pre_post", f"{_SPLIT} SELECT series, count(*) FILTER (phase = 'pre') AS pre, count(*) FILTER (phase = 'post') AS post FROM s GROUP BY 1")
def _(spark, table):
    return _split(table).groupBy("series").agg(F.count_if(F.col("phase") == "pre").alias("pre"), F.count_if(F.col("phase") == "post").alias("post"))


@query("c03_control_screening", f"{_SPLIT} SELECT series, round(corr(x, y), 6) AS r, NULL::VARCHAR AS reason FROM s WHERE phase = 'pre' GROUP BY 1")
def _(spark, table):
    return rounded(causal.screened(_split(table).where("phase = 'pre'")), 6, "r")


_BACKTEST = f"""{_SPLIT}, r AS (SELECT series, x, y, row_number() OVER (PARTITION BY series ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM s WHERE phase = 'pre'), c AS (SELECT *, unnest([0.55, 0.7, 0.82]) AS share FROM r), k AS (SELECT *, least(n - 2, greatest(8, floor(n * 0.45)::BIGINT, floor(n * share)::BIGINT)) AS cut, greatest(2, floor(n * 0.1)::BIGINT) AS size FROM c),
        f AS (SELECT series, cut, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy, count(*) AS m FROM k WHERE i < cut GROUP BY 1, 2), z AS (SELECT k.series, y, my, my + (m * cxy / sx) / (m + 1e-3) / sx * (x - mx) AS f FROM k JOIN f ON k.series = f.series AND k.cut = f.cut WHERE i >= k.cut AND i < k.cut + size)"""


@query(
    "c04_backtest_single",
    f"""{_BACKTEST}
        SELECT series, count(*) AS n_test, round(sqrt(avg((y - f) ** 2)), 3) AS rmse, round(sqrt(avg((y - my) ** 2)), 3) AS baseline_rmse, round(avg(abs(y - f)), 3) AS mae, round(avg(y - f), 3) AS bias FROM z GROUP BY 1""",
)
def _(spark, table):
    made = causal.backtest_single(_split(table).where("phase = 'pre'"))
    return rounded(made.select("series", "n_test", "rmse", "baseline_rmse", "mae", "bias"), 3, "rmse", "baseline_rmse", "mae", "bias")


@query(
    "c05_control_scores",
    f"""{_BACKTEST}, m AS (SELECT series, sqrt(avg((y - f) ** 2)) AS rmse, sqrt(avg((y - my) ** 2)) AS baseline_rmse FROM z GROUP BY 1),
        k2 AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2 AS ry FROM r),
        sp AS (SELECT series, corr(rx, ry) AS spearman, stddev_pop(y) AS sy FROM k2 GROUP BY 1),
        wd AS (SELECT *, greatest(6, n // 2) AS width FROM r), st AS (SELECT *, unnest(list_distinct([0, greatest(0, n - width), greatest(0, (n - width) // 2)])) AS start FROM wd),
        co AS (SELECT series, start, corr(x, y) AS c FROM st WHERE i >= start AND i < start + width GROUP BY 1, 2), sb AS (SELECT series, avg(c) - stddev_pop(c) AS stability FROM co GROUP BY 1)
        SELECT series, round(rmse, 3) AS rmse, round(baseline_rmse, 3) AS baseline_rmse, round(stability, 6) AS stability, round(spearman, 6) AS spearman,
               round(rmse / sy + 0.10 * (1 - greatest(0, stability)) + 0.05 * greatest(0, 0.4 - abs(spearman)), 6) AS score FROM m JOIN sp USING (series) JOIN sb USING (series) WHERE rmse < baseline_rmse""",
)
def _(spark, table):
    made = causal.control_scores(_split(table).where("phase = 'pre'"))
    return rounded(rounded(made, 3, "rmse", "baseline_rmse"), 6, "stability", "spearman", "score")


@query("c06_combinations", "WITH s AS (SELECT DISTINCT o_orderpriority AS s FROM orders) SELECT [a.s] AS combo FROM s a UNION ALL SELECT [a.s, b.s] FROM s a JOIN s b ON a.s < b.s UNION ALL SELECT [a.s, b.s, c.s] FROM s a JOIN s b ON a.s < b.s JOIN s c ON b.s < c.s")
def _(spark, table):
    return causal.combinations(table("orders").select(F.col("o_orderpriority").alias("series")).distinct(), 1, 3)


@query(
    "c07_counterfactual",
    f"""{_SPLIT}, f AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS se FROM s WHERE phase = 'pre' GROUP BY 1)
        SELECT series, period, phase, round(a + b * x, 2) AS predicted, round(a + b * x - 1.959963984540054 * se, 2) AS low, round(a + b * x + 1.959963984540054 * se, 2) AS high FROM s JOIN f USING (series)""",
)
def _(spark, table):
    made = causal.counterfactual_single(_split(table), ["series"])
    return rounded(made.select("series", "period", "phase", "predicted", "low", "high"), 2, "predicted", "low", "high")


_EFFECT = f"""{_SPLIT}, f AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS se FROM s WHERE phase = 'pre' GROUP BY 1), e AS (SELECT series, period, y, a + b * x AS f, y - a - b * x AS e, se FROM s JOIN f USING (series) WHERE phase = 'post')"""


@query("c08_effect_summary", f"{_EFFECT} SELECT series, round(sum(e), 2) AS effect, round(sum(e) / abs(sum(f)) * 100, 6) AS effect_pct, round(sum(e) / (max(se) * sqrt(count(*))), 6) AS z FROM e GROUP BY 1")
def _(spark, table):
    made = causal.effect_summary(causal.counterfactual_single(_split(table), ["series"]), ["series"])
    return rounded(rounded(made.select("series", "effect", "effect_pct", "z"), 2, "effect"), 6, "effect_pct", "z")


@query("c09_cumulative_effect", f"{_EFFECT} SELECT series, period, round(e, 2) AS effect, round(sum(e) OVER w, 2) AS cumulative, round(sum(e) OVER w - 1.959963984540054 * sqrt(sum(se * se) OVER w), 2) AS cumulative_low FROM e WINDOW w AS (PARTITION BY series ORDER BY period)")
def _(spark, table):
    made = causal.effect_series(causal.counterfactual_single(_split(table), ["series"]), ["series"])
    return rounded(made.select("series", "period", "effect", "cumulative", "cumulative_low"), 2, "effect", "cumulative", "cumulative_low")


@query("c10_winner", f"{_BACKTEST} SELECT arg_min(series, (rmse, mae)) AS combo FROM (SELECT series, sqrt(avg((y - f) ** 2)) AS rmse, avg(abs(y - f)) AS mae FROM z GROUP BY 1)")
def _(spark, table):
    """The control whose model errs least before the campaign."""
    tested = causal.backtest_single(_split(table).where("phase = 'pre'")).withColumnRenamed("series", "combo")
    return causal.winners(tested).select("combo")


def _analysis(table, most=2):
    long = _weeks(table).withColumn("kpi", F.lit("revenue"))
    return causal.analyse(long, {"urgent": ["1-URGENT"], "high": ["2-HIGH"]}, _START, _END, most=most)


def _result(name, key):
    @query(name)
    def _(spark, table):
        return _analysis(table)[key]


for _name, _key in (("c11_executive_table", "executive"), ("c12_fan_out_models", "models"), ("c12_fan_out_effects", "effects")):
    _result(_name, _key)

# the same with one control a model, whose back-tests and counterfactuals have closed forms
_FAN = f"""WITH w AS ({_WEEKS}), ys AS (SELECT CASE series WHEN '1-URGENT' THEN 'urgent' ELSE 'high' END AS target, period, value AS y FROM w WHERE series IN ('1-URGENT', '2-HIGH')),
        s AS (SELECT target, series, period, value AS x, y, CASE WHEN period < DATE '{_START}' THEN 'pre' ELSE 'post' END AS phase FROM w JOIN ys USING (period) WHERE series NOT IN ('1-URGENT', '2-HIGH') AND period <= DATE '{_END}'),
        r AS (SELECT target, series, x, y, row_number() OVER (PARTITION BY target, series ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY target, series) AS n FROM s WHERE phase = 'pre'),
        k AS (SELECT *, least(n - 2, greatest(8, floor(n * 0.45)::BIGINT, floor(n * share)::BIGINT)) AS cut, greatest(2, floor(n * 0.1)::BIGINT) AS size FROM (SELECT *, unnest([0.55, 0.7, 0.82]) AS share FROM r)),
        f AS (SELECT target, series, cut, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy, count(*) AS m FROM k WHERE i < cut GROUP BY ALL),
        z AS (SELECT k.target, k.series, y, my, my + (m * cxy / sx) / (m + 1e-3) / sx * (x - mx) AS f FROM k JOIN f ON k.target = f.target AND k.series = f.series AND k.cut = f.cut WHERE i >= k.cut AND i < k.cut + size),
        models AS (SELECT target, series, sqrt(avg((y - f) ** 2)) AS rmse, sqrt(avg((y - my) ** 2)) AS baseline, avg(abs(y - f)) AS mae FROM z GROUP BY ALL HAVING sqrt(avg((y - f) ** 2)) < sqrt(avg((y - my) ** 2))),
        g AS (SELECT target, series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS se FROM s JOIN models USING (target, series) WHERE phase = 'pre' GROUP BY ALL),
        effects AS (SELECT target, series, sum(y) AS actual, sum(y - a - b * x) AS effect, sum(y - a - b * x) / abs(sum(a + b * x)) * 100 AS effect_pct, sum(y - a - b * x) / (max(se) * sqrt(count(*))) AS z FROM s JOIN g USING (target, series) WHERE phase = 'post' GROUP BY ALL)"""


@query("c12_single_models", f"{_FAN} SELECT 'revenue' AS kpi, target, [series] AS combo, round(rmse, 3) AS rmse, round(baseline, 3) AS baseline_rmse, round(mae, 3) AS mae, round((baseline - rmse) / baseline * 100, 6) AS improvement FROM models")
def _(spark, table):
    made = _analysis(table, 1)["models"].select("kpi", "target", "combo", "rmse", "baseline_rmse", "mae", "improvement")
    return rounded(rounded(made, 3, "rmse", "baseline_rmse", "mae"), 6, "improvement")


@query("c12_single_effects", f"{_FAN} SELECT 'revenue' AS kpi, target, [series] AS combo, round(actual, 2) AS actual, round(effect, 2) AS effect, round(effect_pct, 6) AS effect_pct, round(z, 6) AS z FROM effects")
def _(spark, table):
    made = _analysis(table, 1)["effects"].select("kpi", "target", "combo", "actual", "effect", "effect_pct", "z")
    return rounded(rounded(made, 2, "actual", "effect"), 6, "effect_pct", "z")


@query(
    "c11_single_executive",
    f"""{_FAN}, best AS (SELECT target, arg_min(series, (rmse, mae)) AS series FROM models GROUP BY 1)
        SELECT 'revenue' AS kpi, target, round(effect, 2) AS effect, round(effect_pct, 6) AS effect_pct, series AS controls, CASE WHEN abs(z) >= 1.6448536269514722 THEN 'significant' ELSE 'not significant' END AS quality, NULL::VARCHAR AS discarded FROM best JOIN effects USING (target, series)""",
)
def _(spark, table):
    """The winner of each target, chosen before the campaign."""
    made = _analysis(table, 1)["executive"].select("kpi", "target", "effect", "effect_pct", "controls", "quality", "discarded")
    return rounded(rounded(made, 2, "effect"), 6, "effect_pct")


@query("c13_effect_distribution", f"{_EFFECT}, q AS (SELECT series, sum(e) / abs(sum(f)) * 100 AS pct FROM e GROUP BY 1) SELECT count(*) AS models, round(quantile_cont(pct, 0.25), 6) AS q1, round(quantile_cont(pct, 0.5), 6) AS median, round(quantile_cont(pct, 0.75), 6) AS q3 FROM q")
def _(spark, table):
    made = causal.effect_distribution(causal.effect_summary(causal.counterfactual_single(_split(table), ["series"]), ["series"]))
    return rounded(made.select("models", "q1", "median", "q3"), 6, "q1", "median", "q3")


@query("c14_export_matrix", f"""{_BESIDE} SELECT period, round(max(y), 2) AS target, round(max(x) FILTER (series = '2-HIGH'), 2) AS "2-HIGH", round(max(x) FILTER (series = '5-LOW'), 2) AS "5-LOW" FROM p GROUP BY 1""")
def _(spark, table):
    return rounded(causal.export_matrix(causal.paired(_roles(table)), ["2-HIGH", "5-LOW"]), 2, "target", "2-HIGH", "5-LOW")


@query("c15_period_check", f"{_SPLIT} SELECT count(*) FILTER (phase = 'pre') AS pre, count(*) FILTER (phase = 'post') AS post, true AS ok FROM s WHERE series = '2-HIGH'")
def _(spark, table):
    causal.check_dates(("1995-01-01", "1999-12-31"), (_START, _END), ["revenue"], ["1-URGENT"])
    return causal.check_split(_split(table).where("series = '2-HIGH'"), "y").select("pre", "post", "ok")


def _declared():
    from kpi_spark.operators import registry

    return registry.Analysis("needs much", lambda df: {}, dates=1, metrics=4, dimensions=2)


@query("x02_declared_input", "SELECT DISTINCT 'metrics: 4 needed, 3 found' AS problem FROM orders")
def _(spark, table):
    return spark.createDataFrame([(p,) for p in _declared().problems(table("orders"))], "problem string")


@query("x03_parameter_options", "SELECT * FROM (VALUES ('dates', 'o_orderdate'), ('metrics', 'o_orderkey'), ('metrics', 'o_custkey'), ('metrics', 'o_totalprice'), ('dimensions', 'o_orderstatus'), ('dimensions', 'o_orderpriority')) AS t(parameter, \"column\")")
def _(spark, table):
    return spark.createDataFrame([(k, c) for k, cs in _declared().options(table("orders")).items() for c in cs], "parameter string, column string")


@query("x01_registered_analysis", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders")
def _(spark, table):
    from kpi_spark.operators import registry

    registry.register(registry.Analysis("mean of a metric", lambda df, metric: {"mean": df.agg(F.count(F.lit(1)).alias("n"), two(F.avg(metric), 4).alias("mean"))}, metrics=1))
    return registry.execute("mean of a metric", table("orders"), metric="o_totalprice")["mean"]
