"""Registered queries against their SQL on the smallest tables."""

import decimal
import glob
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from kpi_spark import plans

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return float(f"{float(v):.9g}") if isinstance(v, (int, float, np.number, decimal.Decimal)) else v


def values(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).to_numpy().tolist()), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, duck, name):
    assert values(plans.QUERIES[name](spark, SF).toPandas()) == values(duck.execute(plans.ORACLE[name]).df())


def test_whole_tables(spark, duck):
    """Queries over all orders and lines, with the cases that filtered ones leave out."""
    n = lambda q: duck.execute(q).fetchone()[0]
    gaps = plans.QUERIES["a21_gaps_per_customer"](spark, SF).toPandas()
    assert gaps["o_custkey"].nunique() == n("SELECT count(DISTINCT o_custkey) FROM orders") and (gaps["o_totalprice"] == 0).any()
    assert gaps["o_totalprice"].sum() == pytest.approx(n("SELECT sum(o_totalprice) FROM orders"))
    assert plans.QUERIES["j01_all_lines"](spark, SF).count() == n("SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
    last = plans.QUERIES["t06_all_weeks"](spark, SF).where("week = 53")
    assert last.count() == n("SELECT count(*) FROM orders WHERE weekofyear(o_orderdate) = 53") > 0 == last.where("by_week is not null").count()
