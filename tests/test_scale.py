"""Ranks, quantiles, samples and filters that must not depend on one task or on doubles."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpi_spark import sources
from kpi_spark.functions import distributions as dist
from kpi_spark.functions import typing as typ
from kpi_spark.operators import corr, filters, geo, linear, periods, preparation, profile, ranking
from kpi_spark.sources import scratch

SF = "/root/testdata/sf0.001"


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_ranks_and_quantiles(spark, n):
    r = random.Random(n)
    values = [r.choice([None, float("nan"), 5.0, -1e9, r.random()]) if n > 2 else float(i) for i in range(n)]
    plain = sorted(v for v in values if v is not None and v == v)
    df = numbers(spark, values)
    got = {x["value"]: (x["n"], x["before"]) for x in ranking.value_counts(df, "v").collect()}
    assert got == {v: (plain.count(v), sum(p < v for p in plain)) for v in set(plain)}
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = {x["share"]: x["value"] for x in ranking.quantiles(df, "v", shares).collect()}
    assert found == ({s: pytest.approx(np.quantile(plain, s)) for s in shares} if plain else {})
    ranked = {x["id"]: x["rank"] for x in ranking.with_average_rank(df, "v", "rank").collect()}
    assert ranked == {i: None if v is None or v != v else sum(p < v for p in plain) + (plain.count(v) + 1) / 2 for i, v in enumerate(values)}


def test_description_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    rows = {r["column"]: r for r in profile.describe(df).collect()}
    assert rows["x"]["median"] == 2.0 and rows["y"]["median"] is None and rows["y"]["nulls"] == 2


@pytest.mark.parametrize(("n", "values", "per_range"), [(0, 3, 10), (2, 3, 10), (60, 8, 5), (300, 1000, 20), (300, 40, 1000), (200, 1, 10)])
def test_kendall(spark, n, values, per_range):
    """All pairs compared; many ranges, ties, and a value that a third of the rows have."""
    r = np.random.default_rng(n + values)
    x, y = r.integers(0, values, n), r.integers(0, values, n)
    x[: n // 3] = values // 2
    a, b = (np.sign(v[:, None].astype(int) - v[None, :].astype(int))[np.tril_indices(n, -1)] for v in (x, y))
    scale = float(np.abs(a).sum() * np.abs(b).sum()) ** 0.5
    df = spark.createDataFrame([(float(p), int(q)) for p, q in zip(x, y)], "x double, y long").repartition(3)
    found = corr.kendall(df, "x", "y", per_range)
    assert found == pytest.approx((a * b).sum() / scale) if scale else found is None


def test_inversions():
    r = np.random.default_rng(1)
    values, weights = r.integers(0, 9, 200), r.integers(1, 5, 200)
    assert corr.inversions(values, weights) == sum(int(weights[i] * weights[j]) for j in range(200) for i in range(j) if values[i] > values[j])


def test_large_integers_are_told_apart_and_pushed_down(spark, tmp_path):
    big = 2**53
    df = spark.createDataFrame([(big, 1, "1.5"), (big + 1, 2, "2.5"), (None, 3, None)], "k long, i int, t string").withColumn("d", F.col("t").cast("decimal(5,1)"))
    path = str(tmp_path / "t")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    ids = lambda out: sorted(r["i"] for r in out.collect())
    assert ids(filters.value_filter(df, {"k": [big + 1]})) == [2] == ids(filters.tolerant_filter(df, {"k": [str(big + 1), "x"]}))
    assert ids(filters.value_filter(df, {"d": ["2.5", 1.5, 2.55, 10**9]})) == [1, 2] and ids(filters.value_filter(df, {"i": [1.5, 2**40, 3.0, "2"]})) == [2, 3]
    assert ids(filters.value_filter(df, {"i": [1.5]})) == [] == ids(filters.tolerant_filter(df, {"i": ["1.5"]})) and ids(filters.tolerant_filter(df, {"i": ["x"]})) == [1, 2, 3]
    plan = filters.value_filter(df, {"k": [big + 1, 5], "i": [1, 2]})._jdf.queryExecution().executedPlan().toString()
    assert "cast(k" not in plan and "cast(i" not in plan and "In(k, " in plan and "In(i, " in plan


def test_every_kth(spark):
    df = spark.range(0, 103).select((F.col("id") * 3 - 50).alias("k"), F.lit("x").alias("t"))
    for most in (1, 10, 50, 103, 500):
        kept = sorted(r["k"] for r in filters.every_kth(df.repartition(5), "k", most).collect())
        step = max(1, -(-103 // most))
        assert kept == [3 * i - 50 for i in range(0, 103, step)] and len(kept) <= max(most, 1)
    assert filters.every_kth(df.limit(0), "k", 5).count() == 0


def test_histogram(spark):
    values = [0.0, 0.1, 0.1, 29.99, 30.0, 15.0]
    bins = {r["bin"]: r["n"] for r in linear.histogram(numbers(spark, values), "v").collect()}
    assert len(bins) == 30 and sum(bins.values()) == 6 and bins[0] == 3 and bins[29] == 2 and bins[15] == 1
    assert {r["bin"]: r["n"] for r in linear.histogram(numbers(spark, [2.0, 2.0]), "v").collect()}[0] == 2
    assert linear.histogram(numbers(spark, [None]), "v").count() == 0


def test_normal_quantiles(spark):
    from statistics import NormalDist

    shares = [1e-300, 1e-20, 1e-9, 0.001, 0.02, 0.07499, 0.3, 0.5, 0.925001, 0.975, 1 - 1e-12]
    out = numbers(spark, [*shares, 0.0, 1.0, None]).select("id", dist.normal_quantile(F.col("v")).alias("q")).orderBy("id").collect()
    assert [r["q"] for r in out[: len(shares)]] == pytest.approx([NormalDist().inv_cdf(p) for p in shares], rel=1e-13, abs=1e-15)
    assert [r["q"] for r in out[len(shares) :]] == [None] * 3
    placed = linear.residual_quantiles(numbers(spark, [2.0, -1.0, 2.0, None]), "v").orderBy("p").collect()
    assert [(r["v"], r["p"]) for r in placed] == [(-1.0, 0.5 / 3), (2.0, 0.5), (2.0, 2.5 / 3)] and placed[1]["normal"] == 0


def test_counts_come_from_footers(spark, tmp_path):
    """The count is pushed into the scan: no column and no row group is read."""
    path = str(tmp_path / "t.parquet")
    spark.range(5000).repartition(3).write.parquet(path)
    assert sources.parquet_rows(spark, path).first()["n"] == 5000
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = own.read.parquet(path).agg(F.count(F.lit(1)))._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert sources.parquet_rows(spark, str(tmp_path / "none")).first()["n"] == 0


def test_reported_csv(spark, tmp_path):
    """A second encoding, quoted line breaks, and lines that don't fit."""
    (tmp_path / "a.csv").write_bytes('k;name\n1;año\n2;"two\nlines"\nx;bad\n3;plain;more\n4;"quo""ted"\n'.encode("ISO-8859-1"))
    out = sources.read_csv_reported(spark, str(tmp_path / "a.csv"), ";", "k long, name string")
    assert (out.encoding, out.multiline) == ("ISO-8859-1", True)
    assert sorted((r["k"], r["name"]) for r in out.rows.collect()) == [(1, "año"), (2, "two\nlines"), (4, 'quo"ted')]
    assert sorted(r["line"].strip() for r in out.bad.collect()) == ["3;plain;more", "x;bad"]
    assert {r["finding"]: r["n"] for r in out.findings().collect()} == {"rows": 3, "bad rows": 2}
    assert out.rows.count() == 3 and out.bad.count() == 2 and out.rows.select("name").count() == 3
    (tmp_path / "b.csv").write_text("k,v\n1,2.5\n2,ñ\n")
    plain = sources.read_csv_reported(spark, str(tmp_path / "b.csv"))
    assert (plain.encoding, plain.multiline, plain.bad.count()) == ("UTF-8", False, 0) and [t for _, t in plain.rows.dtypes] == ["int", "string"]


def test_roles(spark):
    roles = lambda **columns: filters.suggest_roles(spark.createDataFrame([tuple(columns.values())], list(columns)))
    assert roles(DMA="x", total_gmv=1.0, vendor="v", spend_eur=2.0, día_semana="d") == {"date": None, "region": "DMA", "kpi": "total_gmv", "market": None, "channel": None, "support": "vendor", "investment": "spend_eur"}
    assert roles(sales="text", leads=3)["kpi"] == "leads" and roles(state="s", city="c")["region"] == "state"


def test_causal_data(spark):
    events = spark.createDataFrame([("sale", "2024-01-02", "2024-01-03", 2.0, "promo", False)], "name string, start string, end string, intensity double, grp string, own boolean")
    mapping = spark.createDataFrame([("h1", "north")], "code string, destination string")
    df = spark.createDataFrame([("2024-01-01", " H1 ", "1.5"), ("2024-01-02", "h2", "2"), (None, None, None)], "day string, hotel string, kpi string")
    out = preparation.for_impact(df, events, "day", ["kpi"], mapping, "hotel").collect()
    assert sorted((r["kpi"] or 0.0, r["destination"], r["promo"]) for r in out) == [(0.0, "otros", 0.0), (1.5, "north", 0.0), (2.0, "otros", 2.0)]
    with pytest.raises(ValueError, match="kpi"):
        preparation.for_impact(df.withColumn("kpi", F.lit("x")), events, "day", ["kpi"])
    assert preparation.for_regression(df, events, "day")[1] == ["promo"]


def test_suspicious_columns(spark):
    df = spark.createDataFrame([("007", "1", "a", "5"), ("008", "x", "b", "6"), ("009", "3", "c", None)], "code string, mixed string, name string, good string")
    assert typ.suspicious(df) == {"code": 1.0, "mixed": pytest.approx(2 / 3)} and typ.suspicious(df.select(F.lit(1).alias("i"))) == {}


def test_cuts_grow_with_the_controls(spark):
    from datetime import date, timedelta

    rows = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), 1.0) for i in range(16)], "period date, x double")
    first = lambda k: periods.pseudo_cuts(rows, [], "period", k).agg(F.min("cut")).first()[0]
    assert first(1) == 8 and first(6) == 10 and first(F.lit(7)) == 11


def test_scratch_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_path(Session, "x")


BIG = 1 << 53


def test_ranks_and_places_beyond_doubles(spark):
    keys = [BIG + i for i in range(6)] + [BIG + 1, 3, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["rank"] for r in ranking.with_average_rank(df, "k", "rank").collect()}
    assert got == {3: 1, BIG: 2, BIG + 1: 3.5, BIG + 2: 5, BIG + 3: 6, BIG + 4: 7, BIG + 5: 8, None: None}
    some = spark.createDataFrame([(BIG + i,) for i in range(6)], "k long")  # no column but the key
    assert sorted(r["k"] - BIG for r in filters.every_kth(some, "k", 3).collect()) == [0, 2, 4]
    exact = spark.createDataFrame([("9007199254740993.10",), ("9007199254740993.11",)], "t string").select(F.col("t").cast("decimal(20,2)").alias("d"))
    assert sorted(r["rank"] for r in ranking.with_average_rank(exact, "d", "rank").collect()) == [1, 2]


def test_quantiles_of_all_columns_and_groups(spark):
    r = np.random.default_rng(4)
    n = 3000
    group = [None if g == 3 else f"g{g}" for g in np.where(r.random(n) < 0.6, 0, r.integers(1, 5, n))]  # one holds most rows
    x, y = r.integers(0, 20, n), r.normal(size=n)
    y[::17] = np.nan
    data = [(g, int(a), None if i % 11 == 0 else float(b)) for i, (g, a, b) in enumerate(zip(group, x, y))]
    df = spark.createDataFrame(data, "g string, x int, y double").repartition(5)
    shares = (0.0, 0.1, 0.5, 0.75, 1.0)
    got = {(r["g"], r["column"]): (r["count"], r["q"]) for r in ranking.quantile_table(df, ["x", "y"], shares, ["g"]).collect()}
    for g in set(group):
        for k, c in ((1, "x"), (2, "y")):
            values = [d[k] for d in data if d[0] == g and d[k] is not None and d[k] == d[k]]
            assert got[g, c][0] == len(values) and got[g, c][1] == pytest.approx(list(np.quantile(values, shares)), abs=1e-12)
    assert len(got) == 2 * len(set(group))
    assert ranking.quantile_table(df.limit(0), ["x", "y"], shares, ["g"]).count() == 0
    assert ranking.quantile_table(df.select(F.lit(None).cast("double").alias("z")), ["z"], shares).count() == 0


def test_design_search_by_the_gram_matrix(spark):
    """Every design's figures are those of its two series."""
    r = np.random.default_rng(2)
    days, names = 40, [f"p{i:02d}" for i in range(13)]
    trend = r.normal(size=days).cumsum() + 20
    series = {p: np.abs(trend * (i + 1) + r.normal(size=days) * 3) for i, p in enumerate(names)}
    rows_ = [(d, p, float(v[d])) for p, v in series.items() for d in range(days) if (d, p) != (3, "p05")]
    series["p05"][3] = 0.0  # a missing day counts as 0
    panel = spark.createDataFrame(rows_, "date int, location string, conversions double")
    places = geo.eligible(panel, ["p02"])
    free = {"most_share": 1.0, "least_r2": -1.0, "slope_tolerance": 1e9}
    found = geo.candidates(panel, places, n=1000, **free).collect()
    assert sorted(x["design"] for x in found) == list(range(1, 1001)) and [x["r2"] for x in found] == sorted((x["r2"] for x in found), reverse=True)
    volume = {p: v.sum() for p, v in series.items()}
    for x in found[::7]:
        t, c = sum(series[p] for p in x["treatment"]), sum(series[p] for p in x["control"])
        assert sorted(x["treatment"] + x["control"]) == names and "p02" in x["control"]
        slope = np.cov(t, c)[0, 1] / np.var(c, ddof=1)
        assert (x["r2"], x["slope"], x["share"]) == pytest.approx((np.corrcoef(t, c)[0, 1] ** 2, slope * c.sum() / t.sum(), sum(volume[p] for p in x["treatment"]) / sum(volume.values())))
    limits = {"most_share": sorted(x["share"] for x in found)[700], "least_r2": found[700]["r2"] - 1e-9, "slope_tolerance": 0.5}
    again = geo.candidates(panel.repartition(3), places, n=1000, **limits).collect()
    expected = {x["design"] for x in found if x["share"] <= limits["most_share"] and x["r2"] >= limits["least_r2"] and abs(x["slope"] - 1) <= 0.5}
    assert {x["design"] for x in again} == expected and 0 < len(expected) < 1000
    many = geo.candidates(panel, places, one_in=4, least_r2=0.1, slope_tolerance=1.0)
    assert 0 < many.count() <= 100_000 and many.agg(F.max("share")).first()[0] <= 0.3
    with pytest.raises(ValueError, match="places"):
        geo.candidates(spark.range(3000).selectExpr("1 as date", "cast(id as string) as location", "1.0 as conversions"), spark.range(3000).selectExpr("cast(id as string) as location", "1.0 as volume", "false as fixed"))


def shuffled_rows(spark, f):
    """Rows that the jobs of ``f`` write to shuffles."""
    context = spark.sparkContext._jsc.sc()
    flags = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, flags, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = written()
    f()
    return sum(n for stage, n in written().items() if stage not in before)


def test_filled_gaps_are_not_shuffled(spark):
    """Few rows in long series: shuffles grow with the rows, not with series x periods."""
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    start = date(2020, 1, 1)
    data = [(start + timedelta(days=d), k, 1) for k in range(40) for d in (k, 1999 - k)]
    found = []
    n = shuffled_rows(spark, lambda: found.extend(periods.aggregate(own.createDataFrame(data, "day date, k int, v int"), "day", "D", ["v"], ["k"], fill_gaps=True).collect()))
    assert len(found) == 40 * 2000 and sum(r["v"] for r in found) == 80 and len({(r["period"], r["k"]) for r in found}) == len(found)
    assert 0 < n < 10 * len(data)


@pytest.mark.parametrize("dims", [[], ["k"]])
def test_filled_gaps(spark, dims):
    """Repeated rows stay, null keys are a series, periods outside the grid are left out."""
    week = lambda i: date(2024, 1, 1) + timedelta(days=7 * i)
    data = [(week(4), "a", 1), (week(1), "b", 2), (week(1), "b", 3), (week(2), None, None), (week(0), None, 5), (None, "c", 6), (week(1) + timedelta(days=3), "c", 7), (week(5), "a", 8)]
    got = periods.fill(spark.createDataFrame(data, "period date, k string, v int").select("period", *dims, "v"), "W", ["v"], dims)
    want = []
    for key in {k if dims else 0 for _, k, _ in data}:
        for i in range(6):
            held = [v or 0 for p, k, v in data if p == week(i) and (not dims or k == key)]
            want += [(week(i), *([key] if dims else []), v) for v in held or [0]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert periods.fill(got.limit(0), "W", ["v"], dims).count() == 0
