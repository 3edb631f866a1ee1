"""Sources: Parquet and CSV scans, registered tables, and the full load of a delimited file."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|")


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet scan; only ``columns`` are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def detect_separator(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The separator that splits the first lines into the most columns, weighed by how many lines agree."""
    head = spark.read.text(path).limit(lines).where("trim(value) <> ''")
    fields = head.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("sep"), F.size(F.split("value", f"\\Q{s}\\E", -1)).alias("n")) for k, s in enumerate(SEPARATORS)))).alias("f")).select("f.*")
    agree = fields.where("n > 1").groupBy("k", "sep", "n").agg(F.count(F.lit(1)).alias("rows"))
    total = head.agg(F.count(F.lit(1)).alias("total"))
    best = agree.crossJoin(F.broadcast(total)).orderBy(F.desc(F.col("n") * F.col("rows") / F.col("total")), "k").first()
    return best["sep"] if best else ","


def read_csv(spark: SparkSession, path: str, sep: str = "auto", strict: bool = True, schema: str | None = None) -> DataFrame:
    """A CSV scan with a header and inferred types; strict: a bad row is an error, else it is left out."""
    reader = spark.read.option("header", True).option("sep", detect_separator(spark, path) if sep == "auto" else sep).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


#: Encodings in the order in which they are tried, and the column that holds a line that doesn't fit.
ENCODINGS = ("UTF-8", "ISO-8859-1")
_BAD = "_corrupt_line"


@dataclass(frozen=True)
class Reported:
    """What a tolerant scan read, the lines (one column, ``line``) that it left out, and how it read the file."""

    rows: DataFrame
    bad: DataFrame
    encoding: str
    multiline: bool

    def findings(self) -> DataFrame:
        """(finding, n): rows read and left out."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
        return count(self.rows, "rows").unionByName(count(self.bad, "bad rows"))


def read_csv_reported(spark: SparkSession, path: str, sep: str = "auto", schema: str | None = None) -> Reported:
    """A CSV scan with a header that reads all it can and returns the lines that it can't.

    The plan follows from findings: lines that aren't UTF-8 call for
    the next encoding; a first pass that finds lines with an odd number of quotes reads quoted line
    breaks, which costs the splitting of files.  Each finding is one aggregate over the text.
    """
    sep = detect_separator(spark, path) if sep == "auto" else sep
    lines = spark.read.text(path)
    found = lines.agg(F.count_if(~F.is_valid_utf8("value")).alias("odd"), F.count_if((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("open")).first()
    encoding, multiline = ENCODINGS[1 if found["odd"] else 0], found["open"] > 0
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", multiline).option("escape", '"').option("columnPruning", False)
    if schema is None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reader.option("inferSchema", True).csv(path).schema.fields)
    df = reader.schema(f"{schema}, `{_BAD}` string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).csv(path)
    names = [c for c in df.columns if c != _BAD]
    # nothing of the first column: a scan of the bad lines alone isn't allowed, and the filter of either part must not become one
    line = F.concat(_BAD, F.substring(F.coalesce(F.col(names[0]).cast("string"), F.lit("")), 1, 0))
    return Reported(df.where(line.isNull()).select(*names), df.where(line.isNotNull()).select(line.alias("line")), encoding, multiline)


def register(df: DataFrame, name: str) -> DataFrame:
    """Makes ``df`` known to :func:`sql` under ``name``."""
    df.createOrReplaceTempView(name)
    return df


def sql(spark: SparkSession, query: str) -> DataFrame:
    """A query over registered tables."""
    return spark.sql(query)


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, type) without reading rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def row_count(df: DataFrame) -> int:
    return df.count()


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(n): rows of a Parquet table, as its files' footers say; tasks read the footers, no column and no row group.

    The count is pushed into the scan, in a session of its own whose settings allow it.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    n = own.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(n.first()["n"] or 0,)], "n long")  # without files nothing is counted


@dataclass(frozen=True)
class Opened:
    """A table that is open but not read: its rows' number, first rows and types."""

    df: DataFrame
    rows: int
    preview: DataFrame
    types: dict[str, str]


def open_lazy(spark: SparkSession, path: str, preview: int = 200) -> Opened:
    """Opens a Parquet or delimited file."""
    parquet = path.rstrip("/").endswith(".parquet")
    df = read_parquet(spark, path) if parquet else read_csv(spark, path)
    return Opened(df, parquet_rows(spark, path).first()["n"] if parquet else row_count(df), df.limit(preview), dict(df.dtypes))


def load(spark: SparkSession, path: str, year: int) -> DataFrame:
    """A file with clean numbers and dates, date columns first, ordered by the first of them.  year: for columns that hold only months, weeks or quarters."""
    from kpi_spark.functions import typing as typ
    from kpi_spark.operators import sorting

    df = read_parquet(spark, path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)
    df = typ.parse_dates(typ.clean_numbers(df), year)
    return typ.clean_numbers(sorting.by_first_date(sorting.dates_first(df)), at_least=0.5)


def to_parquet(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Writes a table as Parquet and returns its scan."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)
