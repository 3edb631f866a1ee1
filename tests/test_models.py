"""Periods, models, interrupted series, causal impact, response curves and geo panels."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpi_spark.functions import distributions as dist
from kpi_spark.operators import causal, corr, geo, its, linear, periods, registry, response, sorting, trees


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def series(spark, values, names, start=date(2023, 1, 2), step=7):
    data = [(start + timedelta(days=step * i), *map(float, v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "period date, " + ", ".join(f"{n} double" for n in names))


def test_gaps(spark):
    df = spark.createDataFrame([(date(2026, 1, 1), 1), (date(2026, 2, 1), 2), (date(2026, 4, 1), 3)], "day date, v int")
    sums = lambda f, gaps: [r["v"] for r in periods.aggregate(df, "day", f, ["v"], fill_gaps=gaps).orderBy("period").collect()]
    assert sums("M", True) == [1, 2, 0, 3] and sums("M", False) == [1, 2, 3] and sums("Q", True) == [3, 3] and sums("Y", True) == [6]


def test_snap(spark):
    days = spark.createDataFrame([(date(2024, 1, 10),), (date(2023, 1, 1),), (date(2025, 1, 1),), (date(2024, 2, 1),)], "date date")
    months = spark.createDataFrame([(date(2024, m, 1),) for m in (1, 2, 3)], "period date")
    get = lambda mode: {r[0]: r[1] for r in periods.snap(days, months, mode).collect()}
    assert get("floor")[date(2024, 1, 10)] == date(2024, 1, 1) and get("ceil")[date(2024, 1, 10)] == date(2024, 2, 1)
    assert get("nearest")[date(2024, 1, 10)] == date(2024, 1, 1) and get("floor")[date(2023, 1, 1)] == date(2024, 1, 1) and get("ceil")[date(2025, 1, 1)] == date(2024, 3, 1)


def test_seasonality(spark):
    long = [(20 + 0.1 * t + 5 * math.sin(2 * math.pi * t / 52),) for t in range(156)]
    best = periods.best_season(periods.seasonality(series(spark, long, ["y"]), [], "y", "period", [52]), []).first()
    assert best["season"] == 52 and best["strength"] >= 0.15
    assert periods.seasonality(series(spark, long[:100], ["y"]), [], "y", "period", [52]).count() == 0


def test_distributions():
    assert abs(dist.t_quantile(0.975, 10) - 2.228138852) < 1e-6 and abs(dist.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(dist.z_two_sided(1.959963984540054) - 0.05) < 1e-9


@pytest.fixture(scope="module")
def noisy():
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 2)) * [1.0, 5.0] + [0.0, 3.0]
    return x, 2 + x @ [1.5, -0.3] + r.normal(size=80) * 0.5


def frame(spark, x, y):
    return series(spark, np.column_stack([x, y]).tolist(), ["x1", "x2", "y"])


def test_ols_inference(spark, noisy):
    x, y = noisy
    design = np.column_stack([np.ones(80), x])
    beta = np.linalg.solve(design.T @ design, design.T @ y)
    e = y - design @ beta
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (e @ e) / 77)
    table = linear.fit(frame(spark, x, y), ["x1", "x2"], "y").inference()
    assert np.allclose(table["coef"], beta) and np.allclose(table["se"], se)


def test_regularised_models(spark, noisy):
    x, y = noisy
    df = frame(spark, x, y)
    z = (x - x.mean(0)) / x.std(0)
    ridge = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(linear.fit(df, ["x1", "x2"], "y", "ridge").coefs, ridge)
    for model, one, two in (("lasso", 0.01, 0.0), ("elastic_net", 0.005, 0.005)):
        w = np.array(linear.fit(df, ["x1", "x2"], "y", model).coefs) * x.std(0)
        gradient = z.T @ (z @ w - (y - y.mean())) / 80 + two * w + one * np.sign(w)
        assert np.abs(gradient).max() < 1e-8  # stationary
    bayes = linear.fit(df, ["x1", "x2"], "y", "bayesian_ridge")
    assert np.allclose(bayes.coefs, linear.fit(df, ["x1", "x2"], "y").coefs, atol=0.05)


def test_contributions_add_up(spark, noisy):
    df = frame(spark, *noisy)
    fit = linear.fit(df, ["x1", "x2"], "y")
    out = fit.augmented(df).select(F.max(F.abs(F.col("predicted") - F.col("contribution_baseline") - F.col("contribution_x1") - F.col("contribution_x2")))).first()[0]
    assert out < 1e-9


def test_bootstrap_covers(spark, noisy):
    df = frame(spark, *noisy)
    out = {r["term"]: r for r in linear.bootstrap(df, ["x1", "x2"], "y", "period", replicates=60).collect()}
    assert out["x1"]["low"] < 1.5 < out["x1"]["high"] and 0.01 < out["x1"]["se"] < 0.2
    again = {r["term"]: r["low"] for r in linear.bootstrap(df.repartition(3), ["x1", "x2"], "y", "period", replicates=60).collect()}
    assert all(abs(again[t] - out[t]["low"]) < 1e-9 for t in again)


def test_vif_and_correlation(spark, noisy):
    x, y = noisy
    r = np.corrcoef(x.T)[0, 1]
    out = {q["column"]: q["vif"] for q in corr.vif(frame(spark, x, y), ["x1", "x2"]).collect()}
    assert abs(out["x1"] - 1 / (1 - r * r)) < 1e-9
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0), (4.0, 8.0, 7.0)], "a double, b double, c double")
    assert rows(corr.pairs(df)) == [("a", "b", 1.0), ("a", "c", None), ("b", "c", None)]


def test_holdout_and_rolling(spark):
    df = series(spark, [(t, 4 + 2 * t) for t in range(60)], ["x", "y"])
    test = periods.holdout(df.where(F.col("x") < 30), [], "period")
    assert test.where("test").count() == 6
    folds = periods.expanding_folds(df, [], "period", 1)
    out = linear.out_of_sample(linear.validated(folds, ["x"], "y", ["fold"]), "y", "predicted", "baseline").first()
    assert folds.select("fold").distinct().count() >= 2 and out["rmse"] < 1e-6 < out["baseline_rmse"]


def test_simplest_within_two_percent(spark):
    df = spark.createDataFrame([("ols", 0, 10.1), ("ridge", 1, 10.0), ("net", 2, 10.0)], "model string, complexity int, rmse double").withColumn("candidate", F.lit(True))
    assert linear.choose_model(df) == "ols"
    with pytest.raises(ValueError):
        linear.choose_model(df.withColumn("candidate", F.lit(False)))
    assert sorting.simplest_near_best(df, "rmse", "complexity").first()["model"] == "ols"


def test_its(spark):
    def y(t):
        return 20 + 0.2 * t + 8 * (t >= 48) + 0.45 * max(0, t - 48) + 0.15 * math.sin(t)

    values = [(y(t), float(48 <= t <= 50), math.cos(t / 7)) for t in range(72)]
    out = its.fit(series(spark, values, ["y", "event", "control"]), "period", "y", "event", ["control"])
    assert abs(out.beta[2] - 8) < 1 and abs(out.beta[3] - 0.45) < 0.1 and out.effects().count() == 24
    # HAC by hand
    t = np.arange(72.0)
    x = np.column_stack([np.ones(72), t, t >= 48, np.maximum(0, t - 48), np.cos(t / 7)]).astype(float)
    e = np.array([v[0] for v in values]) - x @ out.beta
    lags, s = 8, np.zeros((5, 5))
    for lag in range(lags + 1):
        g = (x[lag:] * e[lag:, None]).T @ (x[: 72 - lag] * e[: 72 - lag, None])
        s += g if lag == 0 else (1 - lag / (lags + 1)) * (g + g.T)
    bread = np.linalg.inv(x.T @ x)
    assert out.lags == lags and np.allclose(out.covariance, bread @ s @ bread, rtol=1e-6)
    with pytest.raises(ValueError):
        its.fit(series(spark, [(1.0, 1.0)] * 20, ["y", "event"]), "period", "y", "event")


def test_causal_impact(spark):
    r = np.random.default_rng(3)
    base = 100 + np.cumsum(r.normal(size=80))
    start = date(2023, 1, 2)
    rows_ = [("sales", start + timedelta(days=7 * i), s, float(v)) for i in range(80) for s, v in (("A", base[i] + 50 * (i >= 50)), ("B", base[i] * 0.8 + r.normal() * 0.3), ("C", r.normal()))]
    long = spark.createDataFrame(rows_, "kpi string, period date, series string, value double")
    out = causal.analyse(long, {"a": ["A"]}, str(start + timedelta(days=350)), str(start + timedelta(days=553)), most=2)
    best = out["executive"].first()
    assert "B" in best["controls"] and abs(best["effect"] - 50 * 30) < 150 and best["significance"] == "p<=0.01"
    with pytest.raises(ValueError):
        causal.check_dates(("2024-01-01", "2024-02-01"), ("2024-01-15", "2024-03-01"), ["k"], ["t"])


def test_response_curve(spark):
    rows_ = [(date(2024, 1, 1) + timedelta(days=i), "Display", s, 10.0 + i, 5 + 3 * math.log(10.0 + i)) for i in range(6) for s in ("A", "B")]
    df = spark.createDataFrame(rows_, "day date, channel string, support string, investment double, sales double")
    out = response.analyse(df, "day", "channel", "support", "investment", ["sales"], k=1)
    one = out["parameters"].where("level = 'support' and support = 'A'").first()
    assert abs(one["a"] - 5) < 1e-9 and abs(one["b"] - 3) < 1e-9 and one["r2"] > 0.999
    assert out["points"].where("level = 'channel'").count() == 50


def test_geo_panel(spark):
    rows_ = [(date(2024, 1, 1) + timedelta(days=d), p, float(10 + i)) for d in range(8) for i, p in enumerate("ABCDE")]
    df = spark.createDataFrame(rows_, "day date, region string, sessions double")
    panel = geo.panel(df, "day", "region", "sessions")
    assert geo.panel_check(panel).first()["ok"]
    assert not geo.panel_check(panel.where("not (location = 'A' and date = '2024-01-03')")).first()["ok"]
    places = geo.eligible(panel, ["A"], ["E"])
    assert rows(places.select("location", "fixed")) == [("A", True), ("B", False), ("C", False), ("D", False)]
    found = geo.candidates(panel, places, n=20, most_share=0.9, least_r2=-1, slope_tolerance=1e9)
    assert all("A" in r["control"] and "A" not in r["treatment"] for r in found.collect())
    assert rows(geo.place_findings(panel, ["A", "Z"], ["A"])) == [("A", "fixed and excluded"), ("Z", "unknown")]


def test_registry(spark):
    registry.register(registry.Analysis("rows", lambda df: {"n": df.groupBy().count()}, metrics=1))
    assert registry.execute("rows", spark.range(3))["n"].first()[0] == 3
    with pytest.raises(ValueError, match="metrics"):
        registry.execute("rows", spark.createDataFrame([("a",)], "x string"))


def test_stream(spark, tmp_path):
    from kpi_spark.streaming import aggregate_stream

    src = spark.createDataFrame([(date(2024, 1, d), 1.0) for d in (1, 2, 8)], "day date, v double").select(F.col("day").cast("timestamp").alias("ts"), "v")
    src.write.parquet(str(tmp_path / "in"))
    stream = aggregate_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "ts", "W", ["v"])
    q = stream.writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("weekly")) == [(date(2024, 1, 1), 2.0), (date(2024, 1, 8), 1.0)]


def test_huber_of_groups_is_that_of_each(spark):
    """All groups at once; each like a fit of its own, and like the minimum of the loss."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    r = np.random.default_rng(8)
    data = []
    for g in (None, "a", "b"):
        for _ in range(60):
            x1, x2 = r.normal(size=2)
            data.append((g, float(x1), float(x2), float(3 + 2 * x1 - x2 + r.normal() + (40 if r.random() < 0.1 else 0))))
    df = spark.createDataFrame(data, "g string, x1 double, x2 double, y double").where("g is not null")
    made = {m["g"]: m for m in linear.fit_huber_groups(df, ["x1", "x2"], "y", ["g"]).collect()}
    for g in "ab":
        ready = VectorAssembler(inputCols=["x1", "x2"], outputCol="f").transform(df.where(F.col("g") == g))
        done = LinearRegression(featuresCol="f", labelCol="y", loss="huber", epsilon=1.35, maxIter=300, tol=1e-12).fit(ready)
        assert [made[g]["intercept"], *made[g]["coefs"], made[g]["sigma"]] == pytest.approx([done.intercept, *done.coefficients, done.scale], rel=1e-4)
    exact = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    line = linear.fit(exact, ["x"], "y", "huber")
    assert (line.intercept, *line.coefs) == pytest.approx((1, 2))


def test_bootstrap_is_that_of_weighted_fits(spark):
    r = np.random.default_rng(3)
    x, k = r.normal(size=300), np.arange(300)
    y = 1 + 2 * x + r.normal(size=300)
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in zip(k, x, y)], "k int, x double, y double")
    out = {m["term"]: m for m in linear.bootstrap(df, ["x"], "y", "k", replicates=400).collect()}
    s = np.sqrt(np.sum((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2) / 298)
    assert out["x"]["se"] == pytest.approx(s / np.sqrt(np.sum((x - x.mean()) ** 2)), rel=0.15)
    assert out["x"]["median"] == pytest.approx(np.polyfit(x, y, 1)[0], abs=0.02)
    spread = {m["term"]: m for m in linear.bootstrap(df.repartition(7), ["x"], "y", "k", replicates=400).collect()}
    assert all(spread[t][c] == pytest.approx(out[t][c], rel=1e-9) for t in out for c in ("low", "median", "high", "se"))
    assert linear.bootstrap(df.limit(0), ["x"], "y", "k", replicates=10).count() == 0


def brute_split(x, y):
    """The best first cut by trying all."""
    best = min(((((y[x <= c] - y[x <= c].mean()) ** 2).sum() + ((y[x > c] - y[x > c].mean()) ** 2).sum(), c) for c in np.unique(x)[:-1]), key=lambda t: t[0])
    return best[1]


def test_trees(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(50, 2))
    y = np.where(x[:, 0] > 0.3, 5.0, -1.0) + 0.1 * r.normal(size=50)
    one = trees.Tree(trees.coded(x, trees.cuts(x)), y, np.ones(50), 1)
    right = x[:, 0] > brute_split(x[:, 0], y)
    assert one.predict(trees.coded(x, trees.cuts(x))) == pytest.approx(np.where(right, y[right].mean(), y[~right].mean()))
    z = r.uniform(-2, 2, (400, 2))
    t = np.sin(2 * z[:, 0]) + (z[:, 1] > 0) * z[:, 0]
    for model in ("random_forest", "gradient_boosting"):
        made = trees.Ensemble(z[:300], t[:300], model, 300, 42)
        assert 1 - np.mean((made.predict(z[300:]) - t[300:]) ** 2) / np.var(t[300:]) > 0.85
        assert made.importances.sum() == pytest.approx(1) and made.importances[0] > made.importances[1]
    constant = trees.Ensemble(np.ones((5, 1)), np.full(5, 3.0), "gradient_boosting", 10, 1)
    assert constant.predict(np.zeros((2, 1))) == pytest.approx([3, 3]) and constant.importances.sum() == 0
    df = spark.createDataFrame([(i % 2, float(a), float(b), float(c), i % 5 == 0) for i, (a, b, c) in enumerate(zip(z[:, 0], z[:, 1], t))], "fold int, x1 double, x2 double, y double, test boolean")
    scored = linear.validated(df, ["x1", "x2"], "y", ["fold"], "gradient_boosting").collect()
    assert len(scored) == 80 and np.corrcoef([s["y"] for s in scored], [s["predicted"] for s in scored])[0, 1] > 0.9
    alone = trees.Ensemble(*(np.array([[row[c] for c in cols] for row in df.where("fold = 0 and not test").collect()]).squeeze() for cols in (("x1", "x2"), ("y",))), "gradient_boosting", 100, 42)
    mine = next(s for s in scored if s["fold"] == 0)
    assert mine["predicted"] == pytest.approx(alone.predict(np.array([[mine["x1"], mine["x2"]]]))[0])
    told = {(m["fold"], m["term"]): m["importance"] for m in trees.importances(df, ["x1", "x2"], "y", ["fold"], trees=20).collect()}
    assert len(told) == 4 and told[0, "x1"] + told[0, "x2"] == pytest.approx(1)
    compared = linear.compare_models(df, ["x1", "x2"], "y").collect()
    assert [c["model"] for c in sorted(compared, key=lambda c: c["complexity"])] == ["ols", "ridge", "elastic_net", "huber", "random_forest", "gradient_boosting"]
    assert min(compared, key=lambda c: c["rmse"])["model"] in ("random_forest", "gradient_boosting")


def test_its_of_groups_is_that_of_each(spark):
    r = np.random.default_rng(12)
    data = []
    for g, start, n in (("a", 20, 40), ("b", 10, 31), ("short", 5, 30), ("none", 99, 30)):
        for i in range(n):
            data.append((g, i, float(r.normal()), float(3 + 0.2 * i + (5 + 0.7 * (i - start) if i >= start else 0) + r.normal()), int(i >= start)))
    df = spark.createDataFrame(data, "g string, t int, x double, y double, event int")
    groups = its.fit_groups(df.repartition(4), "t", "y", "event", ["g"], ["x"])
    told = groups.coefficients().toPandas()
    assert set(told["g"]) == {"a", "b"}
    effects = groups.effects().toPandas()
    for g in "ab":
        alone = its.fit(df.where(F.col("g") == g), "t", "y", "event", ["x"])
        mine = told[told["g"] == g].drop(columns="g").set_index("term")
        theirs = alone.coefficients().toPandas().set_index("term")
        assert np.allclose(mine.loc[theirs.index].to_numpy(float), theirs.to_numpy(float), rtol=1e-8, atol=1e-10)
        e, f = effects[effects["g"] == g].drop(columns="g").sort_values("period"), alone.effects().toPandas().sort_values("period")
        assert np.allclose(e[f.columns].to_numpy(float), f.to_numpy(float), rtol=1e-8, atol=1e-8)
