"""Recipes, filters, combination, typing and profiles on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from kpi_spark.functions import typing as typ
from kpi_spark.operators import combine, filters, profile, recipe, sorting
from kpi_spark.operators.recipe import TableRecipe
from kpi_spark import sources


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("a", "x", 1, 10), ("a", "y", 2, 20), ("b", "x", 3, 30)], "region string, channel string, sales int, spend int")


def test_filtered_sum(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 10), ("B", 20)], "region string, value int")
    assert rows(TableRecipe(rows=("region",), values=(("value", "sum"),), filters={"region": ["A"]}).to_df(df)) == [("A", 3)]


def test_null_category_is_labelled_and_filters_apply_before_categories(spark):
    df = spark.createDataFrame([("A", None, 2), ("A", "y", 3), ("B", "hidden", 100)], "region string, category string, value int")
    out = TableRecipe(rows=("region",), columns=("category",), values=(("value", "sum"),), filters={"region": ["A"]}).to_df(df)
    assert out.columns == ["region", "(vacío)", "y"] and rows(out) == [("A", 2, 3)]


def test_mixed_pivot(sales):
    out = TableRecipe(rows=("region",), columns=("channel",), values=(("sales", "sum"), ("spend", "sum")), pivoted=("sales",)).to_df(sales)
    assert out.columns == ["region", "x", "y", "spend"] and rows(out) == [("a", 1, 2, 30), ("b", 3, 0, 30)]


def test_missing_cells_by_kind(sales):
    mean = TableRecipe(rows=("region",), columns=("channel",), values=(("sales", "mean"),)).to_df(sales)
    assert rows(mean) == [("a", 1.0, 2.0), ("b", 3.0, None)]


def test_two_pivoted_metrics_are_named_by_both(sales):
    out = TableRecipe(rows=("region",), columns=("channel",), values=(("sales", "sum"), ("spend", "max"))).to_df(sales)
    assert out.columns == ["region", "sales · x", "sales · y", "spend · x", "spend · y"]


def test_blank_headings(spark):
    df = spark.createDataFrame([("2025-01-01", "MIX"), ("2025-01-01", "DGEN"), ("2025-01-02", "MIX")], "day string, strategy string")
    out = TableRecipe(rows=("day",), columns=("strategy",)).to_df(df)
    assert out.columns == ["day", "DGEN", "MIX"] and rows(out) == [("2025-01-01", None, None), ("2025-01-02", None, None)]


def test_strict_number_cast(spark):
    df = spark.createDataFrame([("a", "1", 9), ("b", "bad", 8)], "grp string, amount string, unused int")
    with pytest.raises(Exception, match="bad"):
        TableRecipe(values=(("amount", "sum"),), types={"amount": "numero"}).to_df(df).collect()
    assert rows(TableRecipe(values=(("amount", "sum"),), types={"amount": "numero"}, strict=False).to_df(df)) == [(1.0,)]
    with pytest.raises(ValueError, match="no numéricos"):
        typ.convert(df, {"amount": "numero"})


def test_blank_aggregate_counts_and_unknown_is_refused(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "grp string, label string")
    assert rows(TableRecipe(rows=("grp",), values=(("label", ""),)).to_df(df)) == [("a", 2), ("b", 1)]
    for kind in ("sum", "nonsense"):
        with pytest.raises(ValueError):
            TableRecipe(values=(("label", kind),)).to_df(df)


def test_pivot_width_is_limited(spark):
    with pytest.raises(ValueError, match="more than 50"):
        TableRecipe(columns=("id",), values=(("id", "count"),)).to_df(spark.range(51))


def test_empty_table(spark):
    df = spark.createDataFrame([], "region string, channel string, sales int")
    assert rows(TableRecipe(rows=("region",), columns=("channel",), values=(("sales", "sum"),)).to_df(df)) == []
    assert rows(recipe.totals(df, {"sales": "sum"})) == [("sales", None)]


def test_three_way_merge_names_and_nulls(spark):
    table = lambda v: spark.createDataFrame([(1, v), (None, v + 1)], "key int, value int")
    out = combine.merge([table(10), table(20), table(30)], ["key"])
    assert out.columns == ["key", "value", "value_1", "value_2"] and rows(out) == [(1, 10, 20, 30), (None, 11, 21, 31)]


def test_outer_merge_and_join_guard(spark):
    ones = spark.createDataFrame([(1,)] * 2300, "key int")
    left, right = spark.createDataFrame([(1,)] * 2, "key int"), spark.createDataFrame([(2,)] * 3, "key int")
    assert combine.merge([left, right], ["key"], "outer").count() == 5
    with pytest.raises(ValueError, match="5290000"):
        combine.guarded_merge([ones, ones], ["key"])
    with pytest.raises(ValueError):
        combine.guarded_merge([ones, ones, right], ["key"])
    assert combine.guarded_merge([left, right], ["key"]).count() == 0


def test_stack_needs_a_common_column(spark):
    with pytest.raises(ValueError):
        combine.stack([spark.range(1), spark.range(1).toDF("x")], "common")


@pytest.mark.parametrize(("values", "number"), [(["0012", "0045"], False), (["101", "102", "X103"], False), ([str(i) for i in range(1000)] + ["unknown"], False), (["1.234,56 €", "12,5", "(3,25)", "2.000,1", "1.000,00"], True), (["1", None, "3"], True)])
def test_lossless_numbers(spark, values, number):
    df = spark.createDataFrame([(v,) for v in values], "importe string")
    assert (dict(typ.clean_numbers(df).dtypes)["importe"] == "double") is number


def test_dates_by_name(spark):
    df = spark.createDataFrame([(2, 53, 1, 1999, 86400)], "mes long, semana long, quarter long, year long, fecha long")
    out = [str(v) for v in typ.parse_dates(df, 2020).first()]
    assert out == ["2020-02-01 00:00:00", "2020-12-28 00:00:00", "2020-01-01 00:00:00", "1999-01-01 00:00:00", "1970-01-02 00:00:00"]


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "segment string, value int")
    assert rows(filters.tolerant_filter(df, {"segment": ["a"], "value": [1, "3"]})) == [("a", 1), ("a", 3)]
    assert filters.value_filter(df, {"segment": []}).count() == 0 and filters.value_filter(df, {"segment": None}).count() == 3
    both = filters.Dataset(df).with_filters({"segment": ["a", "b"]}).with_filters({"segment": ["a"]})
    assert both.df.count() == 2 and both.reset().df.count() == 3
    with pytest.raises(ValueError):
        filters.date_range(df, "segment", "2024-02-01", "2024-01-01")


def test_row_profile(spark):
    df = spark.createDataFrame([("2020-01-01", "a", 1.0)] * 300 + [("2026-01-01", "b", None)], "day string, grp string, value double")
    n, nulls, first, last = profile.row_profile(df, "day").first()
    assert (n, nulls, str(first), str(last)) == (301, 1, "2020-01-01", "2026-01-01")
    assert profile.distinct_values(df, "grp") == (["a", "b"], False) and profile.distinct_values(df, "grp", 1) == (["a"], True)


def test_pages(spark):
    df = spark.range(405)
    assert sorting.page_of(405, 99, 200) == 2
    assert [r[0] for r in sorting.page(df, [("id", "asc")], 200, 400).collect()] == [400, 401, 402, 403, 404]


def test_csv_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", 2.5), (2, None, 3.5)], "id int, label string, value double")
    path = sources.write_csv(df, str(tmp_path / "out"), "gzip", ";")
    assert sources.detect_separator(spark, path) == ";"
    assert rows(sources.read_csv(spark, path)) == [(1, "a;b", 2.5), (2, None, 3.5)]
    manifest = sources.save_bundle(spark, str(tmp_path), "2024-01-01", "c", "a b", {"t": df, "more": {"u": df, "n": 3}, "state": "OK"})
    assert [r["name"] for r in manifest.orderBy("name").collect()] == ["more - u", "status", "t"]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(1000).repartition(int(partitions)).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"), (F.col("id") * 3 % 11).alias("v"))
        out = recipe.group(df, ["k"], {"v": "first"}, "o")
        assert rows(out) == [(k, k * 3 % 11) for k in range(7)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_kinds_follow_all_rows(spark):
    """What stands behind the first rows of a sorted table counts."""
    dates = spark.range(0, 600, 1, 1).select(F.when(F.col("id") < 550, "2024-01-02").otherwise("later").alias("fecha"))
    assert typ.date_columns(dates) == []
    numbers = spark.range(0, 5000, 1, 1).select(F.when(F.col("id") < 1000, "x").otherwise("7").alias("a"), F.when(F.col("id") < 600, F.lit(None)).otherwise("1.234,5").alias("importe"))
    assert dict(typ.clean_numbers(numbers).dtypes) == {"a": "string", "importe": "double"}
    names = spark.range(0, 150_000, 1, 1).select(F.when(F.col("id") < 60_000, "same").otherwise(F.col("id").cast("string")).alias("name"))
    assert typ.detect_types(names) == {"name": "texto"}


def test_medians_beside_other_aggregates(spark):
    """Flat and pivoted medians, null keys, groups without values, no row keys."""
    import statistics

    data = [(None if i % 5 == 0 else f"r{i % 3}", f"c.{i % 2}", float(i * 7 % 23) if i % 4 else None, i) for i in range(90)] + [("empty", "c.0", None, 1)]
    df = spark.createDataFrame(data, "r string, c string, v double, w long")
    median = lambda rows_: statistics.median(rows_) if rows_ else None
    made = TableRecipe(rows=("r",), columns=("c",), values=(("v", "median"), ("w", "sum"), ("w", "median")), pivoted=("v",)).to_df(df)
    assert made.columns == ["r", "c.0", "c.1", "w", "w · median"]
    out = {x["r"]: tuple(x)[1:] for x in made.collect()}
    for r in {d[0] for d in data}:
        mine = [d for d in data if d[0] == r]
        cells = [median([d[2] for d in mine if d[1] == c and d[2] is not None]) for c in ("c.0", "c.1")]
        assert out[r] == (*cells, sum(d[3] for d in mine), median([d[3] for d in mine]))
    told = {x["metric"]: x["value"] for x in recipe.totals(df, {"v": "median", "w": "count"}).collect()}
    assert told == {"v": median([d[2] for d in data if d[2] is not None]), "w": 91}
    assert {x["c"]: x["w"] for x in recipe.group(df, ["c"], {"w": "median"}).collect()} == {c: median([d[3] for d in data if d[1] == c]) for c in ("c.0", "c.1")}
    assert recipe.group(df.limit(0), ["c"], {"w": "median"}).count() == 0


def test_sketches_of_parts_merge(spark):
    """Parts that arrive later are added without the old rows; the union is the sketch of all rows."""
    df = spark.range(20_000).selectExpr("id % 7000 as a", "cast(id % 11 as string) as b", "id % 4 as day")
    old = profile.distinct_sketches(df.where("day < 3"), ["a", "b"], F.col("day"))
    new = profile.distinct_sketches(df.where("day = 3"), ["a", "b"], F.col("day"))
    merged = {x["column"]: x["distinct"] for x in profile.merged_distinct(old.unionByName(new)).collect()}
    whole = {x["column"]: x["distinct"] for x in profile.merged_distinct(profile.distinct_sketches(df, ["a", "b"])).collect()}
    assert merged == whole and merged["b"] == 11 and abs(merged["a"] - 7000) < 7000 * 4 * 0.83 / 64
    assert old.count() == 6 and profile.merged_distinct(old.limit(0)).count() == 0
