"""Typing and cleaning of columns.

Decisions about a whole column (number formats, lossless casts, types) come from one
``agg`` over all columns at once; what they decide is then one ``select``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_LABEL = "(vacío)"

# fixed values: how numbers and dates are recognised
NULL_TOKENS = ("", "nan", "NaN", "None", "-", "—", "N/A", "n/a", "null", "NULL")
CURRENCY = r"[€$£¥\s]"
NUMBER_SHAPES = {
    "euro_full": r"^-?\d{1,3}(\.\d{3})+(,\d+)?$",
    "us_full": r"^-?\d{1,3}(,\d{3})+(\.\d+)?$",
    "euro_k": r"^-?\d{1,3}(\.\d{3})+$",
    "us_k": r"^-?\d{1,3}(,\d{3})+$",
    "comma_decimal": r"^-?\d+,\d+$",
    "plain": r"^-?\d+(\.\d+)?$",
}
DATE_WORDS = ("fecha", "date", "dia", "día", "day", "mes", "month", "año", "anio", "year", "semana", "week", "trimestre", "quarter", "timestamp")

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_date_name(name: str) -> bool:
    return any(w in name.lower() for w in DATE_WORDS)


def filled(column: Column | str, label: str = NULL_LABEL) -> Column:
    """Text with a label in place of nulls."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(label))


# -- numbers in text ---------------------------------------------------------------------


def bare_number(column: Column) -> Column:
    """Text without currency signs and spaces, ``(x)`` as ``-x``, null tokens as null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(column.cast("string")), CURRENCY, ""), r"^\((.+)\)$", "-$1")
    return F.when(~bare.isin(*NULL_TOKENS), bare)


def shape_votes(column: Column) -> dict[str, Column]:
    """Aggregates: the share of each number shape among what looks like a number."""
    bare = F.regexp_replace(F.trim(column.cast("string")), CURRENCY, "")
    numberish = F.when(bare.rlike(r"^-?[\d.,]+$"), bare)
    return {name: F.avg(numberish.rlike(shape).cast("double")) for name, shape in NUMBER_SHAPES.items()}


def format_of(votes: dict[str, Column]) -> Column:
    """euro, us, comma_decimal, plain or ambiguous; without any number: plain."""
    at = lambda name, least: F.coalesce(votes[name], F.lit(0.0)) >= least
    return (
        F.when(votes["plain"].isNull(), "plain")
        .when(at("euro_full", 0.7) | at("euro_k", 0.7), "euro")
        .when(at("us_full", 0.7) | at("us_k", 0.7), "us")
        .when(at("comma_decimal", 0.7), "comma_decimal")
        .when(at("plain", 0.9), "plain")
        .otherwise("ambiguous")
    )


def number_formats(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """The dominant number format of each column, in one pass."""
    row = df.agg(*(format_of(shape_votes(F.col(c))).alias(f"f{i}") for i, c in enumerate(columns))).first()
    return {c: row[f"f{i}"] for i, c in enumerate(columns)}


def parse_number(column: Column, form: str) -> Column:
    """A double from text in the given format; null where it isn't one."""
    bare = bare_number(column)
    if form == "euro":
        bare = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    elif form == "us":
        bare = F.replace(bare, F.lit(","), F.lit(""))
    elif form == "comma_decimal":
        bare = F.replace(bare, F.lit(","), F.lit("."))
    return bare.try_cast("double")


def lossless(column: Column, parsed: Column) -> Column:
    """Aggregate: nothing that has a value loses it, and there are no codes with leading zeros."""
    codes = F.count_if(F.trim(column.cast("string")).rlike(r"^[+-]?0\d+$"))
    return (F.count(column) == F.count(parsed)) & (codes == 0)


def suspicious(df: DataFrame, at_least: float = 0.5) -> dict[str, float]:
    """Text columns that stay text although at least that share of their values are numbers, and the share."""
    names = [c for c in text_columns(df) if not is_date_name(c)]
    if not names:
        return {}
    forms = number_formats(df, names)
    parsed = {c: parse_number(F.col(c), forms[c]) for c in names}
    row = df.agg(*(F.struct((F.count(parsed[c]) / F.nullif(F.count(F.col(c)), F.lit(0))).alias("share"), lossless(F.col(c), parsed[c]).alias("whole")).alias(f"c{i}") for i, c in enumerate(names))).first()
    return {c: row[f"c{i}"]["share"] for i, c in enumerate(names) if (row[f"c{i}"]["share"] or 0) >= at_least and not row[f"c{i}"]["whole"]}


def clean_numbers(df: DataFrame, at_least: float = 0.9) -> DataFrame:
    """Text columns become doubles where enough of their values parse and all of the column does without loss.

    One job votes on the formats, a second one checks; both read whole columns.
    """
    names = [c for c in text_columns(df) if not is_date_name(c)]
    if not names:
        return df
    forms = number_formats(df, names)
    parsed = {c: parse_number(F.col(c), forms[c]) for c in names}
    share = {c: F.count(parsed[c]) / F.nullif(F.count(F.col(c)), F.lit(0)) for c in names}
    checks = df.agg(*(((share[c] >= at_least) & lossless(F.col(c), parsed[c])).alias(f"l{i}") for i, c in enumerate(names))).first()
    good = {c for i, c in enumerate(names) if checks[f"l{i}"]}
    return df.select(*(parsed[c].alias(c) if c in good else F.col(c) for c in df.columns)) if good else df


# -- dates -------------------------------------------------------------------------------


def iso_week_start(year: int, week: Column) -> Column:
    """The Monday of an ISO week."""
    fourth = F.make_date(F.lit(year), F.lit(1), F.lit(4))
    return F.date_add(F.date_trunc("week", fourth).cast("date"), ((week - 1) * 7).cast("int"))


def coerce_date(column: Column, name: str, numeric: bool, year: int) -> Column:
    """A naive timestamp by what the column's name says.  year: of months, weeks and quarters without one."""
    low = name.lower()
    has = lambda *words: any(w in low for w in words)
    if not numeric:
        return column.cast("string").try_cast("timestamp")
    n = column.cast("long")
    within = lambda lo, hi: F.when(n.between(lo, hi), n.cast("int"))
    if has("mes", "month"):
        date = F.make_date(F.lit(year), within(1, 12), F.lit(1))
    elif has("año", "ano", "anio", "year"):
        date = F.make_date(within(1900, 2100), F.lit(1), F.lit(1))
    elif has("semana", "week"):
        date = iso_week_start(year, within(1, 53))
        date = F.when(F.extract(F.lit("YEAROFWEEK"), date) == year, date)
    elif has("trimestre", "quarter"):
        date = F.make_date(F.lit(year), (within(1, 4) - 1) * 3 + 1, F.lit(1))
    elif has("fecha", "date", "timestamp"):
        return F.timestamp_seconds(n)
    else:
        return column
    return date.cast("timestamp")


def parse_dates(df: DataFrame, year: int) -> DataFrame:
    """Every column with a date's name becomes a timestamp; a text column that would lose all its values stays."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    named = [c for c in df.columns if is_date_name(c) and isinstance(kinds[c], (T.StringType, *NUMERIC))]
    if not named:
        return df
    dates = {c: coerce_date(F.col(c), c, isinstance(kinds[c], NUMERIC), year) for c in named}
    kept = df.agg(*((F.count(dates[c]) > 0).alias(f"k{i}") for i, c in enumerate(named))).first()
    good = {c for i, c in enumerate(named) if kept[f"k{i}"]}
    return df.select(*(dates[c].alias(c) if c in good else F.col(c) for c in df.columns))


def date_columns(df: DataFrame) -> list[str]:
    """Columns of a date type, and text columns with a date's name whose values all parse."""
    typed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    named = [c for c in text_columns(df) if is_date_name(c)]
    if named:
        parsed = {c: F.count(F.col(c).try_cast("timestamp")) for c in named}
        row = df.agg(*(((parsed[c] == F.count(F.col(c))) & (F.count(F.col(c)) > 0)).alias(f"p{i}") for i, c in enumerate(named))).first()
        typed += [c for i, c in enumerate(named) if row[f"p{i}"]]
    return [c for c in df.columns if c in typed]


# -- semantic types ------------------------------------------------------------------------

TYPES = ("auto", "fecha", "numero", "categorica", "texto", "ignorar")


def detect_types(df: DataFrame) -> dict[str, str]:
    """fecha, numero, categorica (boolean, at most 50 values or under a fifth distinct) or texto."""
    dates = set(date_columns(df))
    out = {c: "fecha" for c in df.columns if c in dates} | dict.fromkeys(numeric_columns(df), "numero")
    rest = [c for c in df.columns if c not in out]
    if rest:
        row = df.agg(*(F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(rest)), *(F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(rest))).first()
        for i, c in enumerate(rest):
            few = row[f"d{i}"] <= 50 or row[f"d{i}"] < 0.2 * row[f"n{i}"]
            out[c] = "categorica" if few or dict(df.dtypes)[c] == "boolean" else "texto"
    return {c: out[c] for c in df.columns}


def typed(column: str, kind: str, strict: bool = True) -> Column:
    """A column cast to a semantic type; strict: a value that isn't a number is an error, else null."""
    c = F.col(column)
    if kind == "fecha":
        return (c.cast("string").cast("timestamp") if strict else c.cast("string").try_cast("timestamp")).alias(column)
    if kind == "numero":
        return (c.cast("double") if strict else c.try_cast("double")).alias(column)
    if kind == "categorica":
        return filled(c).alias(column)
    return c


def convert(df: DataFrame, kinds: dict[str, str], strict: bool = True) -> DataFrame:
    """All columns cast to their semantic types, ignored ones left out; strict: a number cast that loses values is an error."""
    numbers = [c for c, k in kinds.items() if k == "numero" and dict(df.dtypes)[c] == "string"]
    if strict and numbers:
        row = df.agg(*(lossless(F.col(c), F.col(c).try_cast("double")).alias(f"l{i}") for i, c in enumerate(numbers))).first()
        bad = [c for i, c in enumerate(numbers) if not row[f"l{i}"]]
        if bad:
            raise ValueError(f"valores no numéricos: {', '.join(bad)}")
    return df.select(*(typed(c, kinds.get(c, "auto"), strict) for c in df.columns if kinds.get(c) != "ignorar"))


def normalised(df: DataFrame, dates: Iterable[str] = (), numbers: Iterable[str] = (), labels: Iterable[str] = ()) -> DataFrame:
    """Dates as DATE, numbers as DOUBLE, labels filled; what doesn't parse is null."""
    change = {c: F.col(c).try_cast("date") for c in dates} | {c: F.col(c).try_cast("double") for c in numbers} | {c: filled(c) for c in labels}
    return df.select(*(change[c].alias(c) if c in change else F.col(c) for c in df.columns))


def model_frame(df: DataFrame, columns: Iterable[str], target: str, least: int = 10) -> DataFrame:
    """Finite numbers in all model columns; an error with too few rows or a constant target."""
    columns = list(columns)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    out = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in columns}).dropna(subset=columns)
    n, spread = out.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    if n < least:
        raise ValueError(f"at least {least} complete rows are needed, there are {n}")
    if not spread:
        raise ValueError("the target is constant")
    return out
