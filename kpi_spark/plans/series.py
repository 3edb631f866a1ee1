"""Queries on periods, events, windows, response curves and geo panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kpi_spark.operators import filters, geo, periods, preparation, ranking, response
from kpi_spark.plans.base import query, rounded, two


def _monthly(table):
    return periods.aggregate(table("orders"), "o_orderdate", "M", ["o_totalprice"])


@query("a20_monthly_revenue", "SELECT date_trunc('month', o_orderdate)::DATE AS period, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
def _(spark, table):
    kept = filters.value_filter(table("orders"), {"o_orderstatus": ["F", "O"]})
    return rounded(periods.aggregate(kept, "o_orderdate", "M", ["o_totalprice"], ["o_orderpriority"]), 2, "o_totalprice")


def _by_unit(name, unit, freq):
    @query(name, f"SELECT date_trunc('{unit}', l_shipdate)::DATE AS period, l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY 1, 2")
    def _(spark, table):
        return rounded(periods.aggregate(table("lineitem"), "l_shipdate", freq, ["l_quantity"], ["l_returnflag"]), 2, "l_quantity")


for _name, _unit, _freq in (("a20_daily", "day", "D"), ("a20_weekly", "week", "W"), ("a20_quarterly", "quarter", "Q"), ("a20_yearly", "year", "Y")):
    _by_unit(_name, _unit, _freq)


@query(
    "a21_gaps_filled",
    """WITH s AS (SELECT date_trunc('week', o_orderdate)::DATE AS p, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
       g AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL 7 DAY))::DATE AS period FROM s)
       SELECT period, c.o_orderstatus, round(coalesce(v, 0), 2) AS o_totalprice FROM g CROSS JOIN (SELECT DISTINCT o_orderstatus FROM s) c LEFT JOIN s ON s.p = period AND s.o_orderstatus = c.o_orderstatus""",
)
def _(spark, table):
    return rounded(periods.aggregate(table("orders"), "o_orderdate", "W", ["o_totalprice"], ["o_orderstatus"], fill_gaps=True), 2, "o_totalprice")


@query(
    "a21_gaps_per_customer",
    """WITH s AS (SELECT date_trunc('week', o_orderdate)::DATE AS p, o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
       g AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL 7 DAY))::DATE AS period FROM s)
       SELECT period, c.o_custkey, round(coalesce(v, 0), 2) AS o_totalprice FROM g CROSS JOIN (SELECT DISTINCT o_custkey FROM s) c LEFT JOIN s ON s.p = period AND s.o_custkey = c.o_custkey""",
)
def _(spark, table):
    """All orders, where every customer's series has gaps."""
    return rounded(periods.aggregate(table("orders"), "o_orderdate", "W", ["o_totalprice"], ["o_custkey"], fill_gaps=True), 2, "o_totalprice")


@query(
    "a22_wide_matrix",
    """SELECT date_trunc('month', o_orderdate)::DATE AS period, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'), 0), 2) AS "F | 1-URGENT", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O' AND o_orderpriority = '5-LOW'), 0), 2) AS "O | 5-LOW" FROM orders GROUP BY 1""",
)
def _(spark, table):
    long = periods.long_series(table("orders"), "o_orderdate", "M", "o_totalprice", ["o_orderstatus", "o_orderpriority"])
    names = ["F | 1-URGENT", "O | 5-LOW"]
    return rounded(periods.wide_series(long, names), 2, *names)


@query(
    "a22_long_series",
    """WITH s AS (SELECT date_trunc('month', ts)::DATE AS p, event_type AS series, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT DISTINCT unnest(generate_series((SELECT min(p) FROM s), (SELECT max(p) FROM s), INTERVAL 1 MONTH))::DATE AS period)
       SELECT period, n.series, round(coalesce(v, 0), 2) AS value FROM g CROSS JOIN (SELECT DISTINCT series FROM s) n LEFT JOIN s ON s.p = period AND s.series = n.series""",
)
def _(spark, table):
    return rounded(periods.long_series(table("events"), "ts", "M", "value", ["event_type"]), 2, "value")


@query("a23_period_means", "SELECT date_trunc('month', l_shipdate)::DATE AS period, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def _(spark, table):
    return rounded(periods.period_means(table("lineitem"), "l_shipdate", "M", ["l_discount", "l_tax"]), 6, "l_discount", "l_tax")


@query("a24_series_list", "SELECT DISTINCT o_orderstatus || ' | ' || o_orderpriority AS series, 'o_orderstatus=' || o_orderstatus || ';o_orderpriority=' || o_orderpriority AS task FROM orders")
def _(spark, table):
    return periods.series_list(table("orders"), ["o_orderstatus", "o_orderpriority"])


_EVENTS = [("sale", "1996-03-01", "1996-03-20", 1.0, "promo", False), ("spring", "1996-03-10", "1996-05-05", 0.5, "promo", False), ("strike", "1997-07-01", "1997-07-31", 2.0, "other", True)]
_EVENT_SQL = "(VALUES " + ", ".join(f"('{n if own else g}', DATE '{a}', DATE '{b}', {i})" for n, a, b, i, g, own in _EVENTS) + ") AS e(label, a, b, w)"


def _events(spark):
    return spark.createDataFrame(_EVENTS, "name string, start string, end string, intensity double, grp string, own boolean")


@query(
    "j06_event_indicator",
    f"SELECT o_orderkey, coalesce((SELECT sum(w) FROM {_EVENT_SQL} WHERE label = 'promo' AND o_orderdate::DATE BETWEEN a AND b), 0)::DOUBLE AS promo, coalesce((SELECT sum(w) FROM {_EVENT_SQL} WHERE label = 'strike' AND o_orderdate::DATE BETWEEN a AND b), 0)::DOUBLE AS strike FROM orders",
)
def _(spark, table):
    return periods.event_columns(table("orders").select("o_orderkey", "o_orderdate"), _events(spark), "o_orderdate", ["promo", "strike"]).drop("o_orderdate")


@query(
    "m25_event_columns",
    f"SELECT event_id, value, coalesce((SELECT sum(w) FROM {_EVENT_SQL} WHERE label = 'promo' AND ts::DATE BETWEEN a AND b), 0)::DOUBLE AS promo, coalesce((SELECT sum(w) FROM {_EVENT_SQL} WHERE label = 'strike' AND ts::DATE BETWEEN a AND b), 0)::DOUBLE AS strike FROM events",
)
def _(spark, table):
    return preparation.for_regression(table("events").select("event_id", "value", "ts"), _events(spark), "ts")[0].drop("ts")


@query(
    "m26_causal_data",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'area ' || substr(o_orderpriority, 3) ELSE 'otros' END AS destination, round(o_totalprice, 2) AS kpi,
        coalesce((SELECT sum(w) FROM {_EVENT_SQL} WHERE label = 'promo' AND o_orderdate::DATE BETWEEN a AND b), 0)::DOUBLE AS promo, coalesce((SELECT sum(w) FROM {_EVENT_SQL} WHERE label = 'strike' AND o_orderdate::DATE BETWEEN a AND b), 0)::DOUBLE AS strike FROM orders""",
)
def _(spark, table):
    """Destinations by code, a KPI that comes as text, and event columns."""
    orders = table("orders")
    mapping = orders.where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("code"), F.concat(F.lit("area "), F.substring("o_orderpriority", 3, 100)).alias("destination")).distinct()
    rows = orders.select("o_orderkey", "o_orderdate", "o_orderpriority", F.round("o_totalprice", 2).cast("string").alias("kpi"))
    return preparation.for_impact(rows, _events(spark), "o_orderdate", ["kpi"], mapping, "o_orderpriority").drop("o_orderdate", "o_orderpriority")


@query(
    "j07_covariates",
    "WITH m AS (SELECT date_trunc('month', l_shipdate)::DATE AS p, avg(l_discount) AS d FROM lineitem WHERE month(l_shipdate) <> 6 GROUP BY 1), o AS (SELECT date_trunc('month', o_orderdate)::DATE AS period FROM orders GROUP BY 1) SELECT period, round(coalesce(d, (SELECT avg(d) FROM m)), 8) AS l_discount FROM o LEFT JOIN m ON p = period",
)
def _(spark, table):
    means = periods.period_means(table("lineitem").where(F.month("l_shipdate") != 6), "l_shipdate", "M", ["l_discount"])
    return rounded(periods.with_covariates(_monthly(table).select("period"), means, ["l_discount"]), 8, "l_discount")


def _snap(mode, sql):
    @query(f"j11_snap_{mode}", f"WITH p AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS period FROM orders), d AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem), n AS (SELECT date, (SELECT max(period) FROM p WHERE period <= date) AS lo, (SELECT min(period) FROM p WHERE period >= date) AS hi FROM d) SELECT date, {sql} AS snapped FROM n")
    def _(spark, table):
        return periods.snap(table("lineitem").select(F.to_date("l_shipdate").alias("date")), _monthly(table).select("period"), mode)


_snap("floor", "coalesce(lo, hi)")
_snap("ceil", "coalesce(hi, lo)")
_snap("nearest", "CASE WHEN lo IS NULL OR hi IS NULL THEN coalesce(lo, hi) WHEN date - lo <= hi - date THEN lo ELSE hi END")

_SUPPORT = "SELECT l_returnflag AS channel, l_linestatus AS support, l_shipdate::DATE AS date, sum(l_extendedprice * l_discount) AS investment, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3"


def _support(table):
    rows = table("lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("support"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") * F.col("l_discount")).alias("investment"), F.col("l_quantity").alias("value"))
    return rows.groupBy("channel", "support", "date").agg(F.sum("investment").alias("investment"), F.sum("value").alias("value"))


@query("w01_forward_ma", f"SELECT channel, support, date, round(avg(investment) OVER (PARTITION BY channel, support ORDER BY date ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 6) AS ma FROM ({_SUPPORT})")
def _(spark, table):
    rows = _support(table)
    return rows.select("channel", "support", "date", two(periods.moving_average(rows, "investment", ["channel", "support"], "date"), 6).alias("ma"))


@query("w02_cumulative", f"SELECT channel, support, date, round(sum(investment) OVER w, 5) AS investment, round(sum(value) OVER w, 5) AS value FROM ({_SUPPORT}) WINDOW w AS (PARTITION BY channel, support ORDER BY date)")
def _(spark, table):
    by = ["channel", "support"]
    return _support(table).select("channel", "support", "date", *(two(periods.cumulative(c, by, "date"), 5).alias(c) for c in ("investment", "value")))


@query("w03_granularity", "WITH d AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS day FROM orders), g AS (SELECT day - lag(day) OVER (ORDER BY day) AS gap FROM d) SELECT count(*) AS days, median(gap)::DOUBLE AS median_gap, 'M' AS granularity FROM g")
def _(spark, table):
    return periods.granularity(_monthly(table), "period")


@query("w04_consecutive_days", "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), g AS (SELECT day - lag(day) OVER (ORDER BY day) AS gap FROM d) SELECT count(*) AS days, count(*) FILTER (gap > 1) AS gaps, (SELECT count(*) FROM events WHERE ts <> date_trunc('day', ts)) AS with_time FROM g")
def _(spark, table):
    return periods.consecutive(table("events"), "ts")


_PAIRS = "SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS y, sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS x, o_orderstatus AS g FROM orders GROUP BY ALL"


def _pairs(table):
    price = lambda p: F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    return table("orders").groupBy(periods.period("o_orderdate", "M").alias("period"), F.col("o_orderstatus").alias("g")).agg(price("1-URGENT").alias("y"), price("2-HIGH").alias("x"))


@query(
    "w06_correlation_stability",
    f"""WITH p AS ({_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM p), w AS (SELECT *, greatest(6, n // 2) AS width FROM r),
        s AS (SELECT *, unnest(list_distinct([0, greatest(0, n - width), greatest(0, (n - width) // 2)])) AS start FROM w), c AS (SELECT g, start, corr(x, y) AS r FROM s WHERE i >= start AND i < start + width GROUP BY 1, 2) SELECT g, round(avg(r) - stddev_pop(r), 6) AS stability FROM c GROUP BY 1""",
)
def _(spark, table):
    return rounded(periods.correlation_stability(_pairs(table), ["g"], "x", "y", "period"), 6, "stability")


@query(
    "w07_expanding_folds",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({_PAIRS})), k AS (SELECT *, (SELECT max(k) FROM range(2, 6) t(k) WHERE n // (k + 1) >= 10 AND k <= n - 1) AS folds FROM r),
        f AS (SELECT *, unnest(range(1, folds + 1)) AS fold FROM k WHERE folds IS NOT NULL), c AS (SELECT *, n - (folds - fold + 1) * (n // (folds + 1)) AS cut FROM f)
        SELECT g, fold, count(*) FILTER (i < cut) AS train, count(*) FILTER (i >= cut AND i < cut + n // (folds + 1)) AS test FROM c WHERE i < cut + n // (folds + 1) GROUP BY 1, 2""",
)
def _(spark, table):
    folds = periods.expanding_folds(_pairs(table), ["g"], "period", 1)
    return folds.groupBy("g", F.col("fold").cast("long").alias("fold")).agg(F.count_if(~F.col("test")).alias("train"), F.count_if("test").alias("test"))


@query(
    "w08_pseudo_cuts",
    f"""WITH r AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({_PAIRS})), c AS (SELECT *, unnest([0.55, 0.7, 0.82]) AS share FROM r), k AS (SELECT *, least(n - 2, greatest(8, floor(n * 0.45)::BIGINT, floor(n * share)::BIGINT)) AS cut, greatest(2, floor(n * 0.1)::BIGINT) AS size FROM c)
        SELECT g, cut, count(*) FILTER (i < cut) AS train, count(*) FILTER (i >= cut) AS test FROM k WHERE i < cut + size GROUP BY 1, 2""",
)
def _(spark, table):
    cuts = periods.pseudo_cuts(_pairs(table), ["g"], "period")
    return cuts.groupBy("g", F.col("cut").cast("long").alias("cut")).agg(F.count_if(~F.col("test")).alias("train"), F.count_if("test").alias("test"))


@query("w09_holdout", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY period) AS i, count(*) OVER (PARTITION BY g) AS n FROM ({_PAIRS})) SELECT g, period, i > n - greatest(2, ceil(n * 0.2)::BIGINT) AS test FROM r")
def _(spark, table):
    return periods.holdout(_pairs(table), ["g"], "period").select("g", "period", "test")


@query("w10_mean_imputation", "SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0), (SELECT avg(nullif(l_discount, 0)) FROM lineitem)), 8) AS d FROM lineitem")
def _(spark, table):
    rows = table("lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return rounded(periods.impute_mean(rows, "d"), 8, "d")


@query(
    "w11_seasonality",
    """WITH s AS (SELECT o_orderstatus AS g, date_trunc('week', o_orderdate)::DATE AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM s),
       t AS (SELECT g, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM r GROUP BY 1), e AS (SELECT r.*, v - a - b * i AS e FROM r JOIN t USING (g)), c AS (SELECT *, unnest([4, 52]) AS season FROM e), k AS (SELECT * FROM c WHERE n >= 3 * season AND i < (n // season) * season),
       f AS (SELECT *, avg(e) OVER (PARTITION BY g, season, i % season) AS m FROM k) SELECT g, season, round(greatest(0, 1 - sum((e - m) ** 2) / sum(e ** 2)), 6) AS strength FROM f GROUP BY 1, 2""",
)
def _(spark, table):
    weekly = periods.aggregate(table("orders"), "o_orderdate", "W", ["o_totalprice"], ["o_orderstatus"]).withColumnRenamed("o_orderstatus", "g")
    return rounded(periods.seasonality(weekly, ["g"], "o_totalprice", "period", [4, 52]), 6, "strength")


@query("w12_average_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS r FROM part")
def _(spark, table):
    return ranking.with_average_rank(table("part").select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", "r")


@query("w15_position_window", "WITH d AS (SELECT o_orderdate::DATE AS day, row_number() OVER (ORDER BY o_orderdate::DATE) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate::DATE AS o_orderdate FROM orders)) SELECT min(day) FILTER (i = 5) AS first, max(day) FILTER (i = least(900, n - 1)) AS last FROM d")
def _(spark, table):
    return periods.window_of(table("orders"), "o_orderdate", [900, 5])


# -- investment response -----------------------------------------------------------------

_LEVELS = f"""base AS (SELECT channel, support, date, sum(investment) AS investment, sum(value) AS value FROM (SELECT l_returnflag AS channel, l_linestatus AS support, l_shipdate::DATE AS date, l_extendedprice * l_discount AS investment, l_quantity AS value FROM lineitem) WHERE investment > 0 AND value > 0 GROUP BY 1, 2, 3),
levels AS (SELECT 'support' AS level, channel, support, 'value' AS kpi, date, investment, value FROM base UNION ALL SELECT 'channel', channel, NULL, 'value', date, sum(investment), sum(value) FROM base GROUP BY channel, date),
smooth AS (SELECT *, avg(investment) OVER w AS im, avg(value) OVER w AS vm FROM levels WINDOW w AS (PARTITION BY level, channel, support ORDER BY date ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))"""


def _curve_source(table):
    rows = table("lineitem").select("l_shipdate", "l_returnflag", "l_linestatus", (F.col("l_extendedprice") * F.col("l_discount")).alias("investment"), F.col("l_quantity").alias("value"))
    return response.by_level(response.prepared(rows, "l_shipdate", "l_returnflag", "l_linestatus", "investment", ["value"]))


@query("r01_prepared", "SELECT l_returnflag AS channel, count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS investment FROM lineitem WHERE l_extendedprice * l_discount > 0 AND l_quantity > 0 GROUP BY 1")
def _(spark, table):
    rows = table("lineitem").withColumn("investment", F.col("l_extendedprice") * F.col("l_discount"))
    made = response.prepared(rows, "l_shipdate", "l_returnflag", "l_linestatus", "investment", ["l_quantity"])
    return made.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), two(F.sum("investment")).alias("investment"))


@query("r02_smoothed", f"WITH {_LEVELS} SELECT level, channel, support, date, round(im, 6) AS investment_ma, round(vm, 6) AS value_ma FROM smooth")
def _(spark, table):
    return rounded(response.smoothed(_curve_source(table)).select("level", "channel", "support", "date", "investment_ma", "value_ma"), 6, "investment_ma", "value_ma")


@query("r03_log_fit", f"WITH {_LEVELS} SELECT level, channel, support, count(*) AS n, round(regr_intercept(vm, ln(im)), 4) AS a, round(regr_slope(vm, ln(im)), 4) AS b, round(regr_r2(vm, ln(im)), 6) AS r2 FROM smooth GROUP BY 1, 2, 3")
def _(spark, table):
    made = response.curves(response.smoothed(_curve_source(table)))
    return rounded(rounded(made.select("level", "channel", "support", "n", "a", "b", "r2"), 4, "a", "b"), 6, "r2")


@query("r04_marginal", f"WITH {_LEVELS} SELECT level, channel, support, round(median(im), 3) AS median_investment, round(abs(regr_slope(vm, ln(im))) / median(im) * 100, 6) AS marginal_100 FROM smooth GROUP BY 1, 2, 3")
def _(spark, table):
    made = response.curves(response.smoothed(_curve_source(table)))
    return rounded(rounded(made.select("level", "channel", "support", "median_investment", "marginal_100"), 3, "median_investment"), 6, "marginal_100")


@query("r05_summary", f"WITH {_LEVELS}, f AS (SELECT level, channel, support, regr_r2(vm, ln(im)) AS r2 FROM smooth GROUP BY 1, 2, 3) SELECT level, count(*) AS curves, round(avg(r2), 6) AS mean_r2 FROM f GROUP BY 1")
def _(spark, table):
    rows = table("lineitem").withColumn("value", F.col("l_quantity")).withColumn("investment", F.col("l_extendedprice") * F.col("l_discount"))
    return rounded(response.analyse(rows, "l_shipdate", "l_returnflag", "l_linestatus", "investment", ["value"])["summary"].drop("kpi"), 6, "mean_r2")


@query(
    "r06_curve_points",
    f"""WITH {_LEVELS}, f AS (SELECT level, channel, support, regr_intercept(vm, ln(im)) AS a, regr_slope(vm, ln(im)) AS b, min(im) AS lo, max(im) AS hi FROM smooth GROUP BY 1, 2, 3), g AS (SELECT *, lo + (hi - lo) * unnest(range(0, 50)) / 49.0 AS x FROM f)
        SELECT level, channel, support, round(x, 6) AS investment, round(a + b * ln(x), 4) AS expected, round(b / x * 100, 6) AS marginal, round(abs(b) / x * 100, 6) AS marginal_size FROM g""",
)
def _(spark, table):
    smooth = response.smoothed(_curve_source(table))
    made = response.points(smooth, response.curves(smooth)).drop("kpi")
    return rounded(rounded(made, 4, "expected"), 6, "investment", "marginal", "marginal_size")


# -- geo panels --------------------------------------------------------------------------


def _panel(table):
    return geo.panel(table("events"), "ts", "event_type", "value")


@query("g01_kpi_check", "SELECT count(*) AS rows, count(*) - count(v) AS missing, count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) AS not_numeric, count(*) FILTER (TRY_CAST(v AS DOUBLE) = 0) AS zeros FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'x' ELSE (event_id % 5)::VARCHAR END AS v FROM events)")
def _(spark, table):
    v = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 7 == 1, "x").otherwise((F.col("event_id") % 5).cast("string"))
    return geo.kpi_check(table("events").select(v.alias("v")), "v")


@query("g02_geo_panel", "SELECT ts::DATE AS date, trim(event_type) AS location, round(sum(value), 4) AS conversions FROM events GROUP BY 1, 2")
def _(spark, table):
    return rounded(_panel(table), 4, "conversions")


@query("g03_panel_check", "WITH p AS (SELECT DISTINCT ts::DATE AS day, event_type FROM events), d AS (SELECT DISTINCT day FROM p) SELECT (SELECT count(*) FROM d) AS days, 'D' AS granularity, 0::BIGINT AS gaps, (SELECT count(*) FROM (SELECT event_type FROM p GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM d))) AS incomplete, (SELECT count(*) FROM (SELECT event_type FROM p GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM d))) = 0 AS ok")
def _(spark, table):
    return geo.panel_check(_panel(table)).select("days", "granularity", "gaps", "incomplete", "ok")


@query("g04_eligible_places", "SELECT event_type AS location, round(sum(value), 4) AS volume, event_type = 'view' AS fixed FROM events WHERE event_type <> 'click' GROUP BY 1 HAVING sum(value) > 0")
def _(spark, table):
    return rounded(geo.eligible(_panel(table), ["view"], ["click"]), 4, "volume")


@query("g05_balance", "WITH v AS (SELECT event_type AS location, sum(value) AS volume, CASE WHEN event_type < 'm' THEN 'control' ELSE 'treatment' END AS \"group\" FROM events GROUP BY 1) SELECT location, \"group\", round(sum(volume) OVER (PARTITION BY \"group\") / sum(volume) OVER (), 6) AS share FROM v")
def _(spark, table):
    volumes = geo.eligible(_panel(table)).withColumn("group", F.when(F.col("location") < "m", "control").otherwise("treatment"))
    return rounded(geo.balance(volumes).select("location", "group", "share"), 6, "share")


@query("g06_assignments", "SELECT n_regionkey AS design, n_name AS location, CASE WHEN n_nationkey % 2 = 0 THEN 'treatment' ELSE 'control' END AS \"group\" FROM nation")
def _(spark, table):
    half = lambda k: F.collect_list(F.when(F.col("n_nationkey") % 2 == k, F.col("n_name")))
    return geo.assignments(table("nation").groupBy(F.col("n_regionkey").alias("design")).agg(half(0).alias("treatment"), half(1).alias("control")))


@query("g07_design_search")
def _(spark, table):
    panel = geo.panel(table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("place", F.col("c_nationkey").cast("string")), "o_orderdate", "place", "o_totalprice")
    quarters = panel.groupBy(F.trunc("date", "quarter").alias("date"), "location").agg(F.sum("conversions").alias("conversions"))
    return geo.candidates(quarters, geo.eligible(quarters), n=100_000, one_in=4)


@query("w13_cumulative_effect", f"SELECT channel, support, date, round(sum(value) OVER w, 2) AS total, round(1.959963984540054 * sqrt(sum(investment) OVER w), 2) AS half_width FROM ({_SUPPORT}) WINDOW w AS (PARTITION BY channel, support ORDER BY date)")
def _(spark, table):
    run = Window.partitionBy("channel", "support").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _support(table).select("channel", "support", "date", two(F.sum("value").over(run)).alias("total"), two(1.959963984540054 * F.sqrt(F.sum("investment").over(run))).alias("half_width"))
