"""Queries on sources, typing, filters, joins, sets, recipes, profiles and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpi_spark import sources
from kpi_spark.functions import typing as typ
from kpi_spark.operators import combine, filters, profile, recipe, sorting
from kpi_spark.operators.recipe import TableRecipe
from kpi_spark.plans.base import query, rounded, two
from kpi_spark.sources.scratch import scratch_path

# -- sources and sinks -------------------------------------------------------------------


@query("s01_column_subset", "SELECT l_orderkey, l_quantity, l_shipdate::DATE AS day FROM lineitem")
def _(spark, table):
    rows = sources.read_parquet(spark, table.path("lineitem"), ["l_orderkey", "l_quantity", "l_shipdate"])
    return rows.select("l_orderkey", "l_quantity", F.to_date("l_shipdate").alias("day"))


@query("s02_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, table):
    path = sources.write_csv(table("customer"), scratch_path(spark, "csv"), sep=";")
    return sources.read_csv(spark, path).select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"), F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("s03_tolerant_csv", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, table):
    """Rows that don't fit the schema are left out."""
    text = lambda key, balance: table("supplier").select(key.alias("s_suppkey"), balance.alias("s_acctbal"))
    key = F.col("s_suppkey").cast("string")
    rows = text(key, F.col("s_acctbal").cast("string")).unionByName(text(F.concat(F.lit("x"), key), F.lit("not a number")))
    path = sources.write_csv(rows, scratch_path(spark, "tolerant"))
    return sources.read_csv(spark, path, ",", strict=False, schema="s_suppkey long, s_acctbal double").select("s_suppkey", "s_acctbal")


_ODD_SUPPLIERS = "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'x' || s_suppkey || ',oops' WHEN s_suppkey % 10 = 7 THEN s_suppkey || ',1,2,3' END AS line FROM supplier WHERE s_suppkey % 10 IN (3, 7)"


def _odd_suppliers(spark, table):
    """A file of suppliers in which some lines don't fit, and what was read of it."""
    key = F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("x"), key, F.lit(",oops"))).when(F.col("s_suppkey") % 10 == 7, F.concat(key, F.lit(",1,2,3"))).otherwise(F.concat_ws(",", key, F.col("s_acctbal").cast("string")))
    path = scratch_path(spark, "odd")
    spark.range(1).select(F.lit("s_suppkey,s_acctbal").alias("value")).unionByName(table("supplier").select(line.alias("value"))).coalesce(1).write.text(path)
    return sources.read_csv_reported(spark, path, ",", schema="s_suppkey long, s_acctbal double")


@query("s03_good_rows", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 10 NOT IN (3, 7)")
def _(spark, table):
    return _odd_suppliers(spark, table).rows


@query("s03_bad_rows", f"SELECT line FROM ({_ODD_SUPPLIERS})")
def _(spark, table):
    """What the tolerant scan leaves out isn't lost."""
    return _odd_suppliers(spark, table).bad


@query("s04_findings", f"SELECT 'rows' AS finding, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 NOT IN (3, 7)) AS n UNION ALL SELECT 'bad rows', count(*) FROM ({_ODD_SUPPLIERS})")
def _(spark, table):
    return _odd_suppliers(spark, table).findings()


@query("s04_split_csv_rows", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def _(spark, table):
    path = sources.write_csv(table("orders").select("o_orderkey", "o_totalprice"), scratch_path(spark, "split"), "gzip")
    return sources.read_csv(spark, path, sep=",").agg(F.count(F.lit(1)).alias("n"), two(F.sum("o_totalprice")).alias("total"))


@query("s05_separator", "SELECT '|' AS separator, count(*) AS n FROM part")
def _(spark, table):
    path = sources.write_csv(table("part"), scratch_path(spark, "sep"), sep="|")
    found = sources.detect_separator(spark, path)
    return sources.read_csv(spark, path, sep=found).agg(F.count(F.lit(1)).alias("n")).select(F.lit(found).alias("separator"), "n")


@query("s06_registered_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, table):
    sources.register(table("customer"), "kpi_customer")
    return sources.sql(spark, "SELECT c_mktsegment, count(*) AS n FROM kpi_customer GROUP BY 1")


@query("s07_sql_over_tables", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, table):
    for t in ("customer", "nation"):
        sources.register(table(t), f"kpi_{t}")
    return sources.sql(spark, "SELECT n_name, count(*) AS customers FROM kpi_customer JOIN kpi_nation ON c_nationkey = n_nationkey GROUP BY 1")


@query("s08_schema_table", "SELECT CAST(ordinal_position - 1 AS INT) AS position, column_name AS \"column\", CASE WHEN data_type = 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE replace(replace(lower(data_type), 'varchar', 'string'), 'integer', 'int') END AS type FROM information_schema.columns WHERE table_name = 'lineitem'")
def _(spark, table):
    return sources.schema_table(table("lineitem"))


@query("s09_full_load", "SELECT o_orderdate::DATE AS fecha, o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def _(spark, table):
    """Dates and prices that come as text, read, cleaned and ordered by date."""
    text = table("orders").select("o_orderkey", F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"))
    loaded = sources.load(spark, sources.write_csv(text, scratch_path(spark, "load"), sep=";"), 2024)
    return loaded.select(F.to_date("fecha").alias("fecha"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "price")


@query("s10_lazy_open", "SELECT count(*) AS n, least(200, count(*)) AS preview FROM events")
def _(spark, table):
    opened = sources.open_lazy(spark, table.path("events"))
    return opened.preview.agg(F.count(F.lit(1)).alias("preview")).select(F.lit(opened.rows).cast("long").alias("n"), "preview")


@query("s11_csv_to_parquet", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def _(spark, table):
    path = sources.write_csv(table("customer"), scratch_path(spark, "csv"))
    return sources.to_parquet(sources.read_csv(spark, path, sep=","), scratch_path(spark, "parquet")).groupBy("c_nationkey").agg(two(F.sum("c_acctbal")).alias("balance"))


@query("s12_row_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, table):
    """From the footers of the Parquet files."""
    return sources.parquet_rows(spark, table.path("lineitem"))


@query("s12_csv_row_count", "SELECT count(*) AS n FROM supplier")
def _(spark, table):
    return spark.createDataFrame([(sources.row_count(sources.read_csv(spark, sources.write_csv(table("supplier"), scratch_path(spark, "csv")), ",")),)], "n long")


@query("k02_tsv_export", "SELECT p_partkey, p_brand, p_size FROM part")
def _(spark, table):
    path = sources.write_tsv(table("part").select("p_partkey", "p_brand", "p_size"), scratch_path(spark, "tsv"))
    return spark.read.option("header", True).option("sep", "\t").schema("p_partkey long, p_brand string, p_size int").csv(path)


@query("k01_csv_export", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, table):
    path = sources.write_csv(table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), scratch_path(spark, "csv"), "gzip")
    return sources.read_csv(spark, path, sep=",", schema="o_orderkey long, o_custkey long, o_totalprice double")


@query("k03_parquet_export", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def _(spark, table):
    return spark.read.parquet(sources.write_parquet(table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), scratch_path(spark, "parquet")))


@query("k04_filtered_export", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, table):
    data = filters.Dataset(table("orders")).with_filters({"o_orderstatus": ["F"]}).with_columns(["o_orderkey", "o_totalprice"])
    return spark.read.parquet(sources.write_parquet(data.df, scratch_path(spark, "export"), "zstd"))


@query("k05_result_bundle")
def _(spark, table):
    results = {"profile": profile.null_profile(table("orders")), "nested": {"top": profile.top_values(table("orders"), ["o_orderstatus"])}, "state": "OK"}
    return sources.save_bundle(spark, scratch_path(spark, "bundle"), "2024-01-01", "client", "profile", results).drop("path")


@query("k06_materialised_aggregate", "SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def _(spark, table):
    return sources.materialise(table("lineitem").groupBy("l_returnflag").agg(two(F.sum("l_quantity")).alias("quantity")), scratch_path(spark, "aggregate"))


# -- typing ------------------------------------------------------------------------------

_EURO = "replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '_'), '.', ','), '_', '.') || ' €'"


def _euro_text(table):
    """Prices as text with points for thousands and a decimal comma."""
    us = F.format_number("l_extendedprice", 2)
    return table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.concat(F.translate(us, ",.", ".,"), F.lit(" €")).alias("price"))


@query("t01_number_format", "SELECT 'euro' AS price, 'plain' AS quantity")
def _(spark, table):
    rows = _euro_text(table).withColumn("quantity", F.col("l_linenumber").cast("string"))
    return rows.agg(typ.format_of(typ.shape_votes(F.col("price"))).alias("price"), typ.format_of(typ.shape_votes(F.col("quantity"))).alias("quantity"))


@query("t02_smart_number", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem")
def _(spark, table):
    return _euro_text(table).select("l_orderkey", "l_linenumber", typ.parse_number(F.col("price"), "euro").alias("price"))


@query("t03_lossless_guard", "SELECT true AS sizes, false AS codes, false AS names")
def _(spark, table):
    parts = table("part").select(F.col("p_size").cast("string").alias("size"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("code"), "p_name")
    ok = lambda c: typ.lossless(F.col(c), F.col(c).try_cast("double"))
    return parts.agg(ok("size").alias("sizes"), ok("code").alias("codes"), ok("p_name").alias("names"))


@query("t04_clean_numbers", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem")
def _(spark, table):
    return typ.clean_numbers(_euro_text(table).drop("l_extendedprice")).select("l_orderkey", "l_linenumber", "price")


@query("t05_last_chance_numbers", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size FROM part")
def _(spark, table):
    rows = table("part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    return typ.clean_numbers(rows, at_least=0.5)


@query(
    "t06_date_coercion",
    "SELECT DISTINCT month(o_orderdate) AS m, make_date(2024, month(o_orderdate)::INT, 1) AS by_month, make_date(year(o_orderdate)::INT, 1, 1) AS by_year, make_date(2024, (quarter(o_orderdate)::INT - 1) * 3 + 1, 1) AS by_quarter, CASE WHEN weekofyear(o_orderdate) <= 52 THEN (DATE '2024-01-01' + ((weekofyear(o_orderdate) - 1) * 7)::INT)::DATE END AS by_week FROM orders",
)
def _(spark, table):
    d = F.col("o_orderdate")
    rows = table("orders").select(F.month(d).cast("long").alias("m"), F.month(d).alias("mes"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.weekofyear(d).alias("week"))
    to = lambda c: typ.coerce_date(F.col(c), c, True, 2024).cast("date")
    return rows.select("m", to("mes").alias("by_month"), to("year").alias("by_year"), to("quarter").alias("by_quarter"), to("week").alias("by_week")).distinct()


@query(
    "t06_all_weeks",
    "SELECT o_orderkey, weekofyear(o_orderdate) AS week, CASE WHEN weekofyear(o_orderdate) <= 52 THEN (DATE '2024-01-01' + ((weekofyear(o_orderdate) - 1) * 7)::INT)::DATE END AS by_week FROM orders",
)
def _(spark, table):
    """Every order; week 53, which 2024 doesn't have, gives null."""
    rows = table("orders").select("o_orderkey", F.weekofyear("o_orderdate").alias("week"))
    return rows.withColumn("by_week", typ.coerce_date(F.col("week"), "week", True, 2024).cast("date"))


@query("t07_parse_dates", "SELECT event_id, ts::DATE AS day FROM events")
def _(spark, table):
    rows = table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("fecha"))
    return typ.parse_dates(rows, 2024).select("event_id", F.to_date("fecha").alias("day"))


@query("t08_date_columns", "SELECT 'o_orderdate' AS \"column\" UNION ALL SELECT 'fecha_texto' FROM orders GROUP BY ALL HAVING count(o_orderdate) > 0")
def _(spark, table):
    found = typ.date_columns(table("orders").withColumn("fecha_texto", F.col("o_orderdate").cast("string")))
    return spark.createDataFrame([(c,) for c in found], "column string")


_KIND = "SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) < 0.2 * count({c}) THEN 'categorica' ELSE 'texto' END AS kind FROM orders"


@query("t09_semantic_types", "SELECT 'o_orderkey' AS \"column\", 'numero' AS kind UNION ALL SELECT 'o_custkey', 'numero' UNION ALL SELECT 'o_totalprice', 'numero' UNION ALL SELECT 'o_orderdate', 'fecha' UNION ALL " + " UNION ALL ".join(_KIND.format(c=c) for c in ("o_orderstatus", "o_orderpriority")))
def _(spark, table):
    return spark.createDataFrame(list(typ.detect_types(table("orders")).items()), "column string, kind string")


@query("t10_convert_types", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice, o_orderdate::DATE AS day, o_orderstatus FROM orders")
def _(spark, table):
    out = typ.convert(table("orders"), {"o_orderkey": "categorica", "o_totalprice": "numero", "o_orderdate": "fecha", "o_custkey": "ignorar", "o_orderpriority": "ignorar"})
    return out.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), "o_orderstatus")


@query("t11_tolerant_types", "SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS p_name, CAST(p_size AS DOUBLE) AS p_size FROM part")
def _(spark, table):
    return typ.convert(table("part").select("p_partkey", "p_name", "p_size"), {"p_name": "numero", "p_size": "numero"}, strict=False)


@query("t12_typed_recipe", "SELECT coalesce(c_nationkey::VARCHAR, '(vacío)') AS c_nationkey, round(sum(CAST(c_acctbal AS DOUBLE)), 2) AS c_acctbal FROM customer GROUP BY 1")
def _(spark, table):
    text = table("customer").withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
    return rounded(TableRecipe(rows=("c_nationkey",), values=(("c_acctbal", "sum"),), types={"c_nationkey": "categorica", "c_acctbal": "numero"}).to_df(text), 2, "c_acctbal")


@query("t13_normalised", "SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderdate::DATE AS o_orderdate, coalesce(o_orderstatus, '(vacío)') AS o_orderstatus FROM orders")
def _(spark, table):
    return typ.normalised(table("orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), ["o_orderdate"], ["o_orderkey"], ["o_orderstatus"])


@query("t14_fill_labels", "SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '(vacío)') AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, table):
    return table("orders").groupBy(typ.filled(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("t15_model_frame", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS x, round(avg(l_extendedprice), 4) AS y FROM lineitem WHERE l_linenumber <> 3")
def _(spark, table):
    rows = table("lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("x"), "l_extendedprice")
    return typ.model_frame(rows, ["x", "l_extendedprice"], "l_extendedprice").agg(F.count(F.lit(1)).alias("n"), two(F.avg("x"), 6).alias("x"), two(F.avg("l_extendedprice"), 4).alias("y"))


# -- filters -----------------------------------------------------------------------------


@query("p01_projection", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, table):
    return filters.Dataset(table("orders")).with_columns(["o_orderkey", "o_totalprice"]).df


@query("p02_dimension_listing", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(spark, table):
    return TableRecipe(rows=("o_orderstatus", "o_orderpriority")).to_df(table("orders"))


@query("p03_drop_columns", "SELECT n_nationkey, n_name FROM nation")
def _(spark, table):
    return filters.drop_columns(table("nation"), ["n_regionkey"])


@query("p04_key_column", "SELECT o_orderkey, o_orderstatus || ' · ' || o_orderpriority AS key FROM orders")
def _(spark, table):
    return filters.key_column(table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "key", ["o_orderstatus", "o_orderpriority"], drop=True)


@query("p05_value_sets", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(spark, table):
    return filters.value_filter(table("orders"), {"o_orderstatus": ["F", "P"]}).select("o_orderkey", "o_orderstatus")


@query("p05_empty_set", "SELECT o_orderkey FROM orders WHERE false")
def _(spark, table):
    return filters.value_filter(table("orders"), {"o_orderstatus": []}).select("o_orderkey")


@query("p06_tolerant_values", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) AND l_returnflag = 'R'")
def _(spark, table):
    return filters.tolerant_filter(table("lineitem"), {"l_linenumber": ["1", "3", "x"], "l_returnflag": ["R"], "l_tax": ["x"], "l_linestatus": None}).select("l_orderkey", "l_linenumber")


@query("p07_text_filter", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey::VARCHAR IN ('1', '2', '3')")
def _(spark, table):
    return filters.text_filter(table("supplier"), {"s_nationkey": [1, "2", 3], "s_name": []}).select("s_suppkey", "s_name")


@query("p08_filter_conjunction", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, table):
    data = filters.Dataset(table("orders")).with_filters({"o_orderstatus": ["F", "O"]}).with_filters({"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return data.with_columns(["o_orderkey"]).df


@query("p09_date_range", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def _(spark, table):
    return filters.date_range(table("orders"), "o_orderdate", "1997-01-01", "1997-12-31").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("p10_reset", "SELECT count(*) AS n FROM orders")
def _(spark, table):
    return filters.Dataset(table("orders")).with_filters({"o_orderstatus": []}).reset().df.agg(F.count(F.lit(1)).alias("n"))


@query("p11_any_null", "SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '5-LOW') AS p FROM orders) WHERE s IS NULL OR p IS NULL")
def _(spark, table):
    rows = table("orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return rows.where(filters.any_null(rows.columns)).agg(F.count(F.lit(1)).alias("n"))


@query("p12_target_predicate", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'")
def _(spark, table):
    return table("orders").where(filters.task_predicate("o_orderstatus=F|O;o_orderpriority=1-URGENT")).select("o_orderkey")


@query("p14_positive_only", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0 AND l_tax > 0")
def _(spark, table):
    return filters.positive_only(table("lineitem"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber")


@query("p15_clean_places", "SELECT s_suppkey, trim(CASE WHEN s_nationkey % 3 = 0 THEN ' Unknown ' ELSE '  place ' || s_nationkey END) AS place FROM supplier WHERE s_nationkey % 3 <> 0")
def _(spark, table):
    place = F.when(F.col("s_nationkey") % 3 == 0, " Unknown ").otherwise(F.concat(F.lit("  place "), F.col("s_nationkey").cast("string")))
    return filters.clean_places(table("supplier").select("s_suppkey", place.alias("place")), "place")


@query("p16_market_filter", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(spark, table):
    return filters.market_filter(table("customer"), "c_mktsegment", " BuildING ").select("c_custkey")


@query("p17_code_mapping", "SELECT c_custkey, coalesce(n_name, 'otros') AS destination FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def _(spark, table):
    mapping = table("nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("destination"))
    return filters.map_codes(table("customer").select("c_custkey", "c_nationkey"), "c_nationkey", mapping, "destination").drop("c_nationkey")


@query("p18_systematic_sample")
def _(spark, table):
    return filters.systematic_sample(table("orders"), "o_orderkey", 100).select("o_orderkey")


@query("p18_every_kth", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i % greatest(1, ceil(n / 500.0)::BIGINT) = 0")
def _(spark, table):
    return filters.every_kth(table("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500)


@query("p13_dates_first", "SELECT * FROM (VALUES (0, 'o_orderdate'), (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus'), (4, 'o_totalprice'), (5, 'o_orderpriority')) AS t(position, \"column\")")
def _(spark, table):
    return spark.createDataFrame(list(enumerate(sorting.dates_first(table("orders")).columns)), "position int, column string")


@query("p19_column_roles", "SELECT * FROM (VALUES ('date', 'order_date'), ('region', 'zona'), ('kpi', 'total_gmv'), ('market', 'destination_country'), ('channel', 'canal'), ('support', NULL), ('investment', 'gasto')) AS t(role, \"column\")")
def _(spark, table):
    """Words of each role; a text column named like a KPI isn't one."""
    rows = table("orders").select(
        F.col("o_orderpriority").alias("canal"), F.col("o_orderpriority").alias("sales_team"), F.col("o_totalprice").alias("total_gmv"), F.col("o_orderdate").alias("order_date"), F.col("o_custkey").alias("zona"), F.col("o_orderstatus").alias("destination_country"), F.col("o_totalprice").alias("gasto")
    )
    return spark.createDataFrame(list(filters.suggest_roles(rows).items()), "role string, column string")


@query("t04_suspicious_columns", "SELECT 'code' AS \"column\", 1.0::DOUBLE AS share UNION ALL SELECT 'mixed', round(count(*) FILTER (p_partkey % 5 <> 0) / count(*)::DOUBLE, 6) FROM part")
def _(spark, table):
    """Text that is mostly numbers but would lose something as numbers."""
    key = F.col("p_partkey").cast("string")
    rows = table("part").select(F.lpad(key, 12, "0").alias("code"), F.when(F.col("p_partkey") % 5 == 0, "none given").otherwise(key).alias("mixed"), "p_name", key.alias("plain"))
    return rounded(spark.createDataFrame(list(typ.suspicious(rows).items()), "column string, share double"), 6, "share")


@query("p18_seeded_sample")
def _(spark, table):
    return filters.seeded_sample(table("orders"), "o_orderkey", 50).select("o_orderkey")


@query(
    "p20_union_of_targets",
    "SELECT c_mktsegment AS task, 'nation' AS dim, list_sort(list(DISTINCT c_nationkey::VARCHAR)) AS members, CASE WHEN count(DISTINCT c_nationkey) > 1 THEN '(' || array_to_string(list_sort(list(DISTINCT c_nationkey::VARCHAR)), '|') || ')' ELSE min(c_nationkey::VARCHAR) END AS label FROM customer GROUP BY 1",
)
def _(spark, table):
    tasks = table("customer").select(F.col("c_mktsegment").alias("task"), F.lit("nation").alias("dim"), F.col("c_nationkey").cast("string").alias("value"))
    return filters.union_tasks(tasks)


# -- joins and sets ----------------------------------------------------------------------


@query(
    "j01_outer_chain",
    """SELECT coalesce(a.k, b.k, c.k) AS k, a.n, b.n AS n_1, c.n AS n_2
       FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY 1) a
       FULL JOIN (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k
       FULL JOIN (SELECT n_nationkey AS k, count(*) AS n FROM nation WHERE n_regionkey > 1 GROUP BY 1) c ON coalesce(a.k, b.k) IS NOT DISTINCT FROM c.k""",
)
def _(spark, table):
    counts = lambda t, c: table(t).groupBy(F.nullif(c, F.lit(3)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    third = table("nation").where("n_regionkey > 1").groupBy(F.col("n_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return combine.merge([counts("customer", "c_nationkey"), counts("supplier", "s_nationkey"), third], ["k"], "outer")


@query("j01_inner_chain", "SELECT o_orderkey, o_totalprice, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, table):
    lines = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return combine.merge([table("orders").select("o_orderkey", "o_totalprice"), lines], ["o_orderkey"])


@query("j01_all_lines", "SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, table):
    """Every line of every order."""
    lines = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return combine.merge([table("orders").select("o_orderkey", "o_totalprice"), lines], ["o_orderkey"])


@query("j02_left_join", "SELECT n_nationkey AS k, n_name AS name, s_name AS name_r FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def _(spark, table):
    left = table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    right = table("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return combine.join_two(left, right, ["k"], "left")


@query(
    "j03_join_preflight",
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), o AS (SELECT n_nationkey AS k, count(*) AS n FROM nation GROUP BY 1)
       SELECT 1 AS step, CAST(sum(c.n * s.n) AS BIGINT) AS rows FROM c JOIN s USING (k) UNION ALL SELECT 2, CAST(sum(c.n * s.n * o.n) AS BIGINT) FROM c JOIN s USING (k) JOIN o USING (k)""",
)
def _(spark, table):
    keys = [table("customer").select(F.col("c_nationkey").alias("k")), table("supplier").select(F.col("s_nationkey").alias("k")), table("nation").select(F.col("n_nationkey").alias("k"))]
    return combine.join_sizes(keys, ["k"])


@query("j04_lookup_aggregate", "SELECT c_custkey, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, table):
    orders = table("orders").withColumnRenamed("o_custkey", "c_custkey")
    return combine.lookup(table("customer").select("c_custkey"), orders, ["c_custkey"], [two(F.sum("o_totalprice")).alias("total")])


@query("j05_totals_beside_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def _(spark, table):
    made = TableRecipe(rows=("o_orderpriority",), columns=("o_orderstatus",), values=(("o_orderkey", "count"), ("o_totalprice", "sum")), pivoted=("o_orderkey",), cats=("F", "O"))
    return rounded(made.to_df(table("orders")), 2, "o_totalprice")


@query("j08_eligible", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, table):
    keys = table("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return combine.eligible(table("customer"), keys, ["c_nationkey"]).select("c_custkey")


@query("j09_missing_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, table):
    return combine.missing(table("customer").select("c_custkey"), table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "j10_incomplete_panel",
    "WITH p AS (SELECT DISTINCT user_id % 50 AS unit, ts::DATE AS day FROM events WHERE NOT (user_id % 50 IN (3, 4) AND day(ts) = 2)) SELECT unit, count(*) AS periods, (SELECT count(DISTINCT day) FROM p) - count(*) AS missing FROM p GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT day) FROM p)",
)
def _(spark, table):
    panel = table("events").select((F.col("user_id") % 50).alias("unit"), F.to_date("ts").alias("day"), F.dayofmonth("ts").alias("d")).where("not (unit in (3, 4) and d = 2)")
    return combine.incomplete(panel, "unit", "day")


@query("u01_union_all", "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, table):
    customers = table("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return combine.stack([customers, table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))])


@query("u02_union_common", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, table):
    customers = table("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    suppliers = table("supplier").select("s_name", F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return combine.stack([customers, suppliers], "common")


@query("u03_distinct_combinations", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, table):
    return combine.combinations(table("lineitem"), ["l_returnflag", "l_linestatus"])


@query("u04_common_values", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, table):
    return combine.common_values(table("customer").select(F.col("c_nationkey").alias("k")), table("supplier").select(F.col("s_nationkey").alias("k")))


@query("u04_only_in_first", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, table):
    return combine.only_in_first(table("part").select(F.col("p_partkey").alias("k")), table("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")))


@query("u05_duplicate_rows", "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)) AS BIGINT) AS duplicates FROM lineitem")
def _(spark, table):
    return combine.duplicate_rows(table("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


# -- recipes -----------------------------------------------------------------------------

_BY_PRIORITY = {"rows": ("o_orderpriority",)}


@query("a01_group_sum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def _(spark, table):
    return rounded(recipe.group(table("orders"), ["o_custkey"], {"o_totalprice": "sum"}), 2, "o_totalprice")


@query("a02_basic_aggregates", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 6) AS m, min(l_discount) AS lo, max(l_extendedprice) AS hi, count(l_orderkey) AS n FROM lineitem GROUP BY 1")
def _(spark, table):
    a = recipe.aggregate
    return table("lineitem").groupBy("l_returnflag").agg(two(a("sum", F.col("l_quantity"))).alias("s"), two(a("mean", F.col("l_tax")), 6).alias("m"), a("min", F.col("l_discount")).alias("lo"), a("max", F.col("l_extendedprice")).alias("hi"), a("count", F.col("l_orderkey")).alias("n"))


@query("a03_median_by_segment", "SELECT c_mktsegment, round(median(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1")
def _(spark, table):
    return rounded(TableRecipe(rows=("c_mktsegment",), values=(("c_acctbal", "median"),)).to_df(table("customer")), 4, "c_acctbal")


@query("a04_sample_deviation", "SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def _(spark, table):
    return rounded(TableRecipe(**_BY_PRIORITY, values=(("o_totalprice", "std"),)).to_df(table("orders")), 4, "o_totalprice")


@query("a05_first_and_last", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")
def _(spark, table):
    a = recipe.aggregate
    return table("orders").groupBy("o_custkey").agg(a("first", F.col("o_totalprice"), "o_orderkey").alias("first_price"), a("last", F.col("o_totalprice"), "o_orderkey").alias("last_price"))


@query("a06_distinct_count", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS o_custkey FROM orders GROUP BY 1")
def _(spark, table):
    return TableRecipe(**_BY_PRIORITY, values=(("o_custkey", "nunique"),)).to_df(table("orders"))


@query("a07_blank_counts", "SELECT o_orderstatus, count(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, table):
    return TableRecipe(rows=("o_orderstatus",), values=(("o_orderkey", ""),)).to_df(table("orders"))


@query("a08_grand_totals", "SELECT 'l_quantity' AS metric, round(sum(l_quantity), 2) AS value FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 2) FROM lineitem UNION ALL SELECT 'l_partkey', CAST(count(DISTINCT l_partkey) AS DOUBLE) FROM lineitem")
def _(spark, table):
    return rounded(recipe.totals(table("lineitem"), {"l_quantity": "sum", "l_tax": "mean", "l_partkey": "nunique"}), 2, "value")


@query("a09_pivot_status_by_priority", "SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS F, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS O, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS P FROM orders GROUP BY 1")
def _(spark, table):
    return rounded(TableRecipe(**_BY_PRIORITY, columns=("o_orderstatus",), values=(("o_totalprice", "sum"),)).to_df(table("orders")), 2, "F", "O", "P")


@query("a10_pivot_without_rows", "SELECT count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem")
def _(spark, table):
    return TableRecipe(columns=("l_returnflag",), values=(("l_orderkey", "count"),)).to_df(table("lineitem"))


@query(
    "a11_pivot_two_metrics",
    """SELECT l_linestatus, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS "l_quantity · A", round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS "l_quantity · N", round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS "l_quantity · R", max(l_tax) FILTER (l_returnflag = 'A') AS "l_tax · A", max(l_tax) FILTER (l_returnflag = 'N') AS "l_tax · N", max(l_tax) FILTER (l_returnflag = 'R') AS "l_tax · R" FROM lineitem GROUP BY 1""",
)
def _(spark, table):
    made = TableRecipe(rows=("l_linestatus",), columns=("l_returnflag",), values=(("l_quantity", "sum"), ("l_tax", "max"))).to_df(table("lineitem"))
    return rounded(made, 2, *(f"l_quantity · {c}" for c in "ANR"))


@query("a12_joined_pivot_key", """SELECT count(*) FILTER (k = 'A | F') AS "A | F", count(*) FILTER (k = 'N | O') AS "N | O", count(*) FILTER (k = 'R | (vacío)') AS "R | (vacío)" FROM (SELECT l_returnflag || ' | ' || coalesce(CASE WHEN l_returnflag <> 'R' THEN l_linestatus END, '(vacío)') AS k FROM lineitem)""")
def _(spark, table):
    rows = table("lineitem").withColumn("status", F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")))
    return TableRecipe(columns=("l_returnflag", "status"), values=(("l_orderkey", "count"),), cats=("A | F", "N | O", "R | (vacío)")).to_df(rows)


@query("a13_mixed_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def _(spark, table):
    made = TableRecipe(**_BY_PRIORITY, columns=("o_orderstatus",), values=(("o_orderkey", "count"), ("o_totalprice", "mean")), pivoted=("o_orderkey",))
    return rounded(made.to_df(table("orders")), 4, "o_totalprice")


@query("a14_missing_cells", "SELECT n_name, coalesce(round(sum(s_acctbal) FILTER (n_regionkey = 0), 2), 0) AS \"0\", coalesce(round(sum(s_acctbal) FILTER (n_regionkey = 1), 2), 0) AS \"1\" FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(spark, table):
    rows = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(TableRecipe(rows=("n_name",), columns=("n_regionkey",), values=(("s_acctbal", "sum"),), cats=("0", "1")).to_df(rows), 2, "0", "1")


@query("a14_missing_means", "SELECT n_name, round(avg(s_acctbal) FILTER (n_regionkey = 0), 4) AS \"0\", round(avg(s_acctbal) FILTER (n_regionkey = 1), 4) AS \"1\" FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(spark, table):
    rows = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(TableRecipe(rows=("n_name",), columns=("n_regionkey",), values=(("s_acctbal", "mean"),), cats=("0", "1")).to_df(rows), 4, "0", "1")


@query("a15_pivot_categories", "SELECT DISTINCT o_orderpriority AS category FROM orders")
def _(spark, table):
    return spark.createDataFrame([(c,) for c in recipe.categories(table("orders"), ["o_orderpriority"])], "category string")


@query("a16_blank_headings", "SELECT DISTINCT o_orderpriority, NULL::VARCHAR AS F, NULL::VARCHAR AS O, NULL::VARCHAR AS P FROM orders")
def _(spark, table):
    return TableRecipe(**_BY_PRIORITY, columns=("o_orderstatus",)).to_df(table("orders"))


@query("a17_classic_pivot", """SELECT c_nationkey, round(coalesce(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 0), 4) AS "c_acctbal - BUILDING", round(coalesce(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 0), 4) AS "c_acctbal - MACHINERY" FROM customer GROUP BY 1""")
def _(spark, table):
    made = recipe.classic_pivot(table("customer"), "c_nationkey", "c_mktsegment", {"c_acctbal": "mean"}, ["BUILDING", "MACHINERY"])
    return rounded(made, 4, "c_acctbal - BUILDING", "c_acctbal - MACHINERY")


@query("a18_metric_twice", """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice, max(o_totalprice) AS "o_totalprice · max" FROM orders GROUP BY 1""")
def _(spark, table):
    return rounded(TableRecipe(rows=("o_orderstatus",), values=(("o_totalprice", "sum"), ("o_totalprice", "max"))).to_df(table("orders")), 2, "o_totalprice")


@query("a19_full_recipe", "SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS F, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS O FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' GROUP BY 1")
def _(spark, table):
    kept = [p for p in recipe.categories(table("orders"), ["o_orderpriority"]) if p != "5-LOW"]
    made = TableRecipe(**_BY_PRIORITY, columns=("o_orderstatus",), values=(("o_totalprice", "sum"),), filters={"o_orderstatus": ["F", "O"], "o_orderpriority": kept}, order=(("F", "desc"),))
    return rounded(made.to_df(table("orders")), 2, "F", "O")


@query("a25_distinct_of_column", "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def _(spark, table):
    return table("lineitem").agg(F.count_distinct("l_suppkey").alias("n"))


# -- profiles ----------------------------------------------------------------------------


@query("f01_null_profile", "SELECT 'o_orderkey' AS \"column\", count(*) AS rows, count(*) - count(o_orderkey) AS nulls FROM orders UNION ALL SELECT 'status', count(*), count(*) - count(nullif(o_orderstatus, 'P')) FROM orders")
def _(spark, table):
    return profile.null_profile(table("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")))


@query("f02_row_profile", "SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'P') AS rows_with_nulls, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders")
def _(spark, table):
    return profile.row_profile(table("orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), "o_orderdate")


@query("f03_numeric_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")))
def _(spark, table):
    return rounded(profile.numeric_profile(table("lineitem"), ["l_quantity", "l_discount", "l_linenumber"]), 4, "mean")


@query("f04_categorical_profile")
def _(spark, table):
    return profile.categorical_profile(table("customer"))


@query("f05_numeric_cards", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM part" for c in ("p_size", "p_retailprice")))
def _(spark, table):
    return rounded(profile.numeric_cards(table("part"), ["p_size", "p_retailprice"]), 4, "null_pct", "mean", "std")


@query("f06_top5_values", """SELECT "column", value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY ALL)) WHERE rank <= 5""")
def _(spark, table):
    return profile.top_values(table("part"), ["p_brand", "p_size"]).withColumn("rank", F.col("rank").cast("long"))


@query("f07_distinct_values", "SELECT DISTINCT c_mktsegment AS value FROM customer")
def _(spark, table):
    values, _ = profile.distinct_values(table("customer"), "c_mktsegment")
    return spark.createDataFrame([(v,) for v in values], "value string")


@query("f08_sample_profile")
def _(spark, table):
    return profile.sample_profile(table("part"), "p_brand")


@query("f09_date_span", "SELECT min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS days FROM events")
def _(spark, table):
    return profile.date_span(table("events"), "ts").withColumn("days", F.col("days").cast("long"))


@query("f10_distinct_estimate")
def _(spark, table):
    return profile.distinct_estimate(table("lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


@query("f10_merged_sketches", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS within FROM lineitem" for c in ("l_partkey", "l_suppkey", "l_returnflag")))
def _(spark, table):
    """Sketches of each month, stored and merged, beside the exact counts: within four standard errors."""
    columns = ["l_partkey", "l_suppkey", "l_returnflag"]
    stored = sources.materialise(profile.distinct_sketches(table("lineitem"), columns, F.trunc("l_shipdate", "month")), scratch_path(spark, "sketches"))
    exact = profile.per_column(table("lineitem"), columns, exact=F.count_distinct)
    joined = profile.merged_distinct(stored).join(exact, "column")
    return joined.select("column", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= 4 * 0.83 / 64 * F.col("exact")).alias("within"))


@query("f11_descriptive_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c})::DOUBLE AS max FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def _(spark, table):
    return rounded(profile.describe(table("orders")), 4, "null_pct", "mean", "std", "q1", "median", "q3")


@query("f11_descriptive_text", """SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", arg_min(value, (-n, value)) AS top, max(n) AS freq FROM (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY ALL) GROUP BY 1""")
def _(spark, table):
    return profile.describe_text(table("orders"), ["o_orderpriority", "o_orderstatus"])


@query("f12_mapping_coverage", "SELECT coalesce(n_name, 'otros') AS destination, count(*) AS rows FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, table):
    mapping = table("nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("destination"))
    return profile.mapping_coverage(filters.map_codes(table("customer"), "c_nationkey", mapping, "destination"), "destination")


@query("f13_column_kinds", "SELECT CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'fecha' WHEN data_type = 'VARCHAR' THEN 'categorica' ELSE 'numero' END AS kind, count(*) AS columns FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1")
def _(spark, table):
    return profile.column_kinds(table("lineitem"))


@query("f14_filterable_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM lineitem HAVING count(DISTINCT {c}) BETWEEN 2 AND {n}" for c, n in (("l_orderkey", 200), ("l_partkey", 200), ("l_suppkey", 200), ("l_linenumber", 200), ("l_quantity", 200), ("l_extendedprice", 200), ("l_discount", 200), ("l_tax", 200), ("l_returnflag", 500), ("l_linestatus", 500))))
def _(spark, table):
    return profile.filterable(table("lineitem")).select("column")


# -- order -------------------------------------------------------------------------------


@query("o01_by_first_date", "SELECT o_orderdate::DATE AS day, o_orderkey FROM orders")
def _(spark, table):
    rows = table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return sorting.by_first_date(sorting.dates_first(rows), "o_orderkey")


@query("o02_multi_sort", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, table):
    rows = table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return sorting.sort(rows, [("n", "desc"), ("o_orderpriority", "asc")])


@query("o03_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 400")
def _(spark, table):
    return sorting.page(table("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 200, 400)


@query("o04_preview")
def _(spark, table):
    made = TableRecipe(rows=("o_orderstatus",), values=(("o_totalprice", "sum"),))
    shown = sorting.preview(table("orders"), made.to_df)
    return shown.df.withColumn("approximate", F.lit(shown.approximate))


@query("o05_first_rows")
def _(spark, table):
    return table("events").limit(200)


@query("o06_top_per_group", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def _(spark, table):
    return sorting.top_per_group(table("customer"), ["c_nationkey"], F.col("c_acctbal"), 5, "c_custkey").select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("o07_simplest_near_best", "WITH s AS (SELECT p_size, avg(p_retailprice) AS m FROM part GROUP BY 1) SELECT p_size FROM s WHERE m <= (SELECT min(m) FROM s) * 1.02 ORDER BY p_size LIMIT 1")
def _(spark, table):
    means = table("part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m"))
    return sorting.simplest_near_best(means, "m", "p_size").select("p_size")
