"""Projection, filters and predicates, and the immutable dataset that carries them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpi_spark.functions.typing import NUMERIC
from kpi_spark.operators.ranking import value_counts

Values = Mapping[str, Iterable | None]

# fixed values: what a missing place is called, and the words by which the roles of columns are known
EMPTY_PLACES = ("(not set)", "", "nan", "none", "unknown", "(vacío)")
ROLE_WORDS = {
    "date": ("fecha", "date", "dia", "day"),
    "region": ("region", "región", "location", "geo", "provincia", "state", "ciudad", "city", "municipio", "dma", "zona"),
    "kpi": ("engagedsessions", "engaged_sessions", "sessions", "conversions", "conversiones", "ventas", "sales", "revenue", "totalrevenue", "gmv", "kpi", "leads", "checkouts"),
    "market": ("destination_country", "country", "pais", "país", "market", "mercado", "region_country"),
    "channel": ("canal", "channel"),
    "support": ("soporte", "partner", "vendor", "platform", "source"),
    "investment": ("inversión", "spend", "cost", "gasto", "investment"),
}
#: Roles that only numeric columns can have.
NUMERIC_ROLES = ("kpi", "investment")


def combined(p: Column, q: Column) -> Column:
    return p & q


def typed_literals(values: Iterable, kind: T.DataType) -> list[Column]:
    """Numbers as literals of a numeric column's own type, so that the test stays on the bare column; what the type can't hold is left out."""
    out = []
    for v in values:
        number = Decimal(str(v).strip())
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            out.append(F.lit(float(number)))
        elif isinstance(kind, T.DecimalType):
            if number.is_finite() and number == round(number, kind.scale) and abs(number) < Decimal(10) ** (kind.precision - kind.scale):
                out.append(F.lit(str(number)).cast(kind))
        elif number.is_finite() and number == number.to_integral_value() and -(1 << (_BITS[type(kind)] - 1)) <= number < 1 << (_BITS[type(kind)] - 1):
            out.append(F.lit(int(number)).cast(kind))
    return out


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def in_values(column: str, values: Iterable | None, kind: T.DataType | None = None) -> Column:
    """``column`` has one of the values, converted to its type; no values: no rows; None: no filter."""
    if values is None:
        return F.lit(True)
    values = list(values)
    if not values:
        return F.lit(False)
    if isinstance(kind, NUMERIC):
        literals = typed_literals(values, kind)
        return F.col(column).isin(literals) if literals else F.lit(False)
    if isinstance(kind, T.StringType):
        values = [str(v) for v in values]
    return F.col(column).isin(values)


def value_filter(df: DataFrame, filters: Values) -> DataFrame:
    """Rows that pass every column's value set."""
    return df.where(reduce(combined, (in_values(c, v, df.schema[c].dataType) for c, v in filters.items()), F.lit(True)))


def tolerant_filter(df: DataFrame, filters: Values) -> DataFrame:
    """Numeric columns ignore values that aren't numbers; with none left such a column isn't filtered."""

    def parsed(values: Iterable) -> list[Decimal]:
        out = []
        for v in values:
            try:
                out.append(Decimal(str(v).strip()))
            except InvalidOperation:
                continue
        return out

    tests = []
    for c, values in filters.items():
        if values is None:
            continue
        if isinstance(df.schema[c].dataType, NUMERIC):
            numbers = parsed(values)
            tests += [in_values(c, numbers, df.schema[c].dataType)] if numbers else []
        else:
            tests.append(in_values(c, [str(v) for v in values]))
    return df.where(reduce(combined, tests, F.lit(True)))


def text_filter(df: DataFrame, filters: Values) -> DataFrame:
    """Values compared as text; an empty set doesn't filter."""
    tests = [F.col(c).cast("string").isin([str(v) for v in values]) for c, values in filters.items() if values]
    return df.where(reduce(combined, tests, F.lit(True)))


def intersect_filters(x: Values, y: Values) -> dict[str, list | None]:
    """The conjunction of two filter sets."""
    out: dict[str, list | None] = {}
    for c in [*x, *(c for c in y if c not in x)]:
        a, b = x.get(c), y.get(c)
        out[c] = list(b) if a is None and b is not None else list(a) if b is None and a is not None else None if a is None else [v for v in a if v in set(b)]
    return out


def date_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included and optional; what isn't a date is left out."""
    if start and end and start > end:
        raise ValueError("the range starts after its end")
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):  # bounds on the bare column reach the scan
        test = F.col(column).isNotNull()
        test = test & (F.col(column) >= F.lit(start).cast("timestamp")) if start else test
        test = test & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")) if end else test
        return df.where(test)
    day = F.col(column) if isinstance(kind, T.DateType) else F.col(column).try_cast("date")
    test = day.isNotNull()
    test = test & (day >= F.lit(start).cast("date")) if start else test
    return df.where(test & (day <= F.lit(end).cast("date")) if end else test)


def any_null(columns: Iterable[str]) -> Column:
    return reduce(lambda p, q: p | q, (F.col(c).isNull() for c in columns), F.lit(False))


def key_column(df: DataFrame, name: str, parts: Iterable[str], sep: str = " · ", drop: bool = False) -> DataFrame:
    """A column of the parts' texts, joined; nulls count as empty."""
    parts = list(parts)
    out = df.withColumn(name, F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts)))
    return out.drop(*(c for c in parts if c != name)) if drop else out


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    gone = set(columns)
    if gone >= set(df.columns):
        raise ValueError("at least one column must stay")
    return df.drop(*gone)


def parse_task(text: str) -> dict[str, list[str]]:
    """``col=v1|v2;col2=w`` as allowed values by column."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        column, _, values = part.partition("=")
        out[column.strip()] = [v.strip() for v in values.split("|") if v.strip()]
    return out


def task_predicate(task: str | Mapping[str, Iterable[str]]) -> Column:
    """Rows of a target: all of its columns have one of their values."""
    task = parse_task(task) if isinstance(task, str) else task
    return reduce(combined, (F.trim(F.col(c).cast("string")).isin(list(v)) for c, v in task.items()), F.lit(True))


def union_tasks(tasks: DataFrame, group: str = "task", dim: str = "dim", value: str = "value") -> DataFrame:
    """(group, dim, members, label): the values of each dimension merged over the tasks of a group, in order, once each."""
    members = F.array_sort(F.collect_set(value))
    return tasks.groupBy(group, dim).agg(members.alias("members")).withColumn("label", F.when(F.size("members") > 1, F.concat(F.lit("("), F.array_join("members", "|"), F.lit(")"))).otherwise(F.array_join("members", "|")))


def positive_only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Complete rows in which all the columns are above 0."""
    columns = list(columns)
    return df.dropna(subset=columns).where(reduce(combined, (F.col(c) > 0 for c in columns)))


def clean_places(df: DataFrame, column: str) -> DataFrame:
    """Trimmed places, without those that only say that none is known."""
    return df.withColumn(column, F.trim(F.col(column).cast("string"))).where(F.col(column).isNotNull() & ~F.lower(column).isin(*EMPTY_PLACES))


def market_filter(df: DataFrame, column: str, market: str) -> DataFrame:
    return df.where(F.lower(F.trim(F.col(column))) == market.strip().lower())


def map_codes(df: DataFrame, code: str, mapping: DataFrame, out: str, other: str = "otros") -> DataFrame:
    """``out``: what a mapping (code, destination) says for the trimmed upper-case code, else ``other``."""
    known = mapping.select(F.upper(F.trim("code")).alias("_code"), F.col("destination").alias(out)).dropDuplicates(["_code"])
    joined = df.withColumn("_code", F.upper(F.trim(F.col(code).cast("string")))).join(known, "_code", "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(other))).select(*df.columns, out)


def systematic_sample(df: DataFrame, key: str, step: int) -> DataFrame:
    """About one row in ``step``, by a hash of its key, alike however the rows are dealt."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0)


def every_kth(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, one in k by their place in the order of a numeric key, from the first one on; k is the least that is enough.

    Rows of one key stay in one range of the count that finds the places.
    """
    rest = [c for c, t in df.dtypes if not t.startswith("map")]
    numbered = df.withColumn("_among", F.row_number().over(Window.partitionBy(key).orderBy(*rest)))
    counts = value_counts(df, key).select(F.col("value").alias("_value"), F.col("before").alias("_before"), F.col("total").alias("_rows"))
    placed = numbered.join(counts, F.col(key) == F.col("_value"))  # in the key's own type
    place = F.col("_before") + F.col("_among") - 1
    return placed.where(place % F.greatest(F.lit(1), F.ceil(F.col("_rows") / most)) == 0).select(*df.columns)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows at random; the same ones for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def suggest_roles(df: DataFrame) -> dict[str, str | None]:
    """The first column whose name holds a word of each role; KPIs and investments are numeric."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)}
    fits = lambda c, role: any(w in c.lower() for w in ROLE_WORDS[role]) and (role not in NUMERIC_ROLES or c in numeric)
    return {role: next((c for c in df.columns if fits(c, role)), None) for role in ROLE_WORDS}


@dataclass(frozen=True)
class Dataset:
    """A table with filters, a projection and date bounds; every method gives a new one, nothing runs."""

    base: DataFrame
    filters: Values = field(default_factory=dict)
    columns: tuple[str, ...] | None = None
    dates: tuple[str, str | None, str | None] | None = None

    def with_filters(self, filters: Values) -> Dataset:
        return replace(self, filters=intersect_filters(self.filters, filters))

    def with_columns(self, columns: Iterable[str]) -> Dataset:
        return replace(self, columns=tuple(columns))

    def with_date_range(self, column: str, start: str | None = None, end: str | None = None) -> Dataset:
        return replace(self, dates=(column, start, end))

    def reset(self) -> Dataset:
        return Dataset(self.base)

    @property
    def df(self) -> DataFrame:
        out = value_filter(self.base, self.filters)
        out = date_range(out, *self.dates) if self.dates else out
        return out.select(*self.columns) if self.columns else out


