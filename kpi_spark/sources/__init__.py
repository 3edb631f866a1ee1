"""Reading and writing tables."""

from kpi_spark.sources.readers import detect_separator, load, open_lazy, parquet_rows, read_csv, read_csv_reported, read_parquet, register, row_count, schema_table, sql, to_parquet
from kpi_spark.sources.writers import materialise, save_bundle, write_csv, write_parquet, write_tsv

__all__ = ["detect_separator", "load", "materialise", "open_lazy", "parquet_rows", "read_csv", "read_csv_reported", "read_parquet", "register", "row_count", "save_bundle", "schema_table", "sql", "to_parquet", "write_csv", "write_parquet", "write_tsv"]
