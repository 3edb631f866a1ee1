"""Sinks: delimited files, Parquet, and bundles of named result tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpi_spark.sources.readers import to_parquet

#: zstd needs a Hadoop build with that codec.
CSV_COMPRESSIONS = ("none", "gzip", "zstd")
PARQUET_COMPRESSIONS = ("snappy", "zstd", "gzip", "lz4", "none")


def write_csv(df: DataFrame, path: str, compression: str = "none", sep: str = ",") -> str:
    """Delimited files with a header, one for each partition."""
    if compression not in CSV_COMPRESSIONS:
        raise ValueError(f"compression must be one of {CSV_COMPRESSIONS}")
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("compression", compression).csv(path)
    return path


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> str:
    return write_csv(df, path, compression, "\t")


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> str:
    if compression not in PARQUET_COMPRESSIONS:
        raise ValueError(f"compression must be one of {PARQUET_COMPRESSIONS}")
    to_parquet(df, path, compression)
    return path


def materialise(df: DataFrame, path: str) -> DataFrame:
    """An aggregated table, computed once and opened again from Parquet."""
    return to_parquet(df, path)


def flatten(results: dict, prefix: str = "") -> tuple[dict[str, DataFrame], dict[str, object]]:
    """The tables of nested results by joined names, and the scalars among them."""
    tables, scalars = {}, {}
    for key, value in results.items():
        name = f"{prefix} - {key}" if prefix else str(key)
        if isinstance(value, DataFrame):
            tables[name] = value
        elif isinstance(value, dict) or isinstance(value, (list, tuple)) and any(isinstance(v, (DataFrame, dict)) for v in value):
            inner = value if isinstance(value, dict) else {i + 1: v for i, v in enumerate(value)}
            more, also = flatten(inner, name)
            tables |= more
            scalars |= also
        else:
            scalars[name] = value
    return tables, scalars


def save_bundle(spark: SparkSession, root: str, date: str, client: str, analysis: str, results: dict) -> DataFrame:
    """Writes all tables under ``root/date/client/analysis`` and, last, a manifest, which is returned.

    Scalars become a table (field, value); names that meet get a number behind them.
    """
    safe = lambda s: re.sub(r"[^\w.-]+", "_", str(s)).strip("_") or "table"
    folder = "/".join([root.rstrip("/"), *map(safe, (date, client, analysis))])
    tables, scalars = flatten(results)
    if scalars:
        rows = [(k, v if isinstance(v, str) else json.dumps(v, default=str)) for k, v in scalars.items()]
        tables["status"] = spark.createDataFrame(rows, "field string, value string")
    used: dict[str, int] = {}
    manifest = []
    for name, df in tables.items():
        used[safe(name)] = n = used.get(safe(name), 0) + 1
        path = f"{folder}/{safe(name)}" + (f"_{n}" if n > 1 else "")
        df.write.mode("overwrite").parquet(path)
        manifest.append((name, path, len(df.columns), spark.read.parquet(path).count()))
    out = spark.createDataFrame(manifest, "name string, path string, columns int, rows long")
    out.coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return out.withColumn("analysis", F.lit(analysis))
