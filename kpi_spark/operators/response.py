"""Investment response: smoothing, log curves, marginal returns and saturation points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpi_spark.functions.typing import filled
from kpi_spark.operators.periods import cumulative, moving_average


def prepared(df: DataFrame, date: str, channel: str, support: str, investment: str, kpis: Sequence[str]) -> DataFrame:
    """(channel, support, kpi, date, investment, value): one row a KPI; no investment is 0, labels filled, only rows above 0 in both."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value")) for k in kpis))
    rows = df.select(F.to_date(F.col(date)).alias("date"), filled(channel).alias("channel"), filled(support).alias("support"), F.coalesce(F.col(investment).cast("double"), F.lit(0.0)).alias("investment"), F.explode(pairs).alias("k"))
    return rows.where("date is not null").select("channel", "support", "k.kpi", "date", "investment", "k.value").where("investment > 0 and value > 0")


def by_level(rows: DataFrame) -> DataFrame:
    """(level, channel, support, kpi, date, investment, value), summed by day, for each support and for whole channels (support null)."""
    sums = (F.sum("investment").alias("investment"), F.sum("value").alias("value"))
    support = rows.groupBy("channel", "support", "kpi", "date").agg(*sums)
    channel = support.groupBy("channel", "kpi", "date").agg(*sums).select(F.lit("channel").alias("level"), "channel", F.lit(None).cast("string").alias("support"), "kpi", "date", "investment", "value")
    return support.select(F.lit("support").alias("level"), "channel", "support", "kpi", "date", "investment", "value").unionByName(channel)


KEYS = ["level", "channel", "support", "kpi"]


def smoothed(levels: DataFrame, k: int = 2) -> DataFrame:
    """With forward moving averages and running sums of investment and KPI."""
    return levels.withColumns({"investment_ma": moving_average(levels, "investment", KEYS, "date", k), "value_ma": moving_average(levels, "value", KEYS, "date", k), "investment_sum": cumulative("investment", KEYS, "date"), "value_sum": cumulative("value", KEYS, "date")})


def curves(smooth: DataFrame) -> DataFrame:
    """(keys, n, a, b, r2, median_investment, marginal_100) of value = a + b ln(investment), from three points that vary on."""
    x = F.ln("investment_ma")
    rows = smooth.where("investment_ma > 0")
    out = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.regr_intercept("value_ma", x).alias("a"), F.regr_slope("value_ma", x).alias("b"), F.regr_r2("value_ma", x).alias("r2"), F.median("investment_ma").alias("median_investment"), F.stddev_pop(x).alias("_s"))
    return out.where("n >= 3 and _s > 1e-12").drop("_s").withColumn("marginal_100", F.abs("b") / F.col("median_investment") * 100)


def points(smooth: DataFrame, models: DataFrame, steps: int = 50) -> DataFrame:
    """(keys, investment, expected, marginal, marginal_size): each curve on an even grid of its investments; the slope keeps its sign in marginal."""
    span = smooth.where("investment_ma > 0").groupBy(*KEYS).agg(F.min("investment_ma").alias("lo"), F.max("investment_ma").alias("hi"))
    same = [models[k].eqNullSafe(span[k]) for k in KEYS]
    grid = models.join(span, same).select(*(models[k] for k in KEYS), "a", "b", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    at = grid.withColumn("investment", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(steps - 1)))
    return at.select(*KEYS, "investment", (F.col("a") + F.col("b") * F.ln("investment")).alias("expected"), (F.col("b") / F.col("investment") * 100).alias("marginal"), (F.abs("b") / F.col("investment") * 100).alias("marginal_size"))


def analyse(df: DataFrame, date: str, channel: str, support: str, investment: str, kpis: Sequence[str], k: int = 2) -> dict[str, DataFrame]:
    smooth = smoothed(by_level(prepared(df, date, channel, support, investment, kpis)), k)
    models = curves(smooth)
    summary = models.groupBy("level", "kpi").agg(F.count(F.lit(1)).alias("curves"), F.avg("r2").alias("mean_r2"))
    return {"parameters": models, "normalised": smooth, "points": points(smooth, models), "summary": summary}
