"""Columns of the input whose names an operator uses for its own results."""

from __future__ import annotations

from pyspark.sql import DataFrame

_PREFIX = "_kept_"


def hidden(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns of these names (in any case) put aside under other ones."""
    return df.withColumnsRenamed({c: _PREFIX + c for c in df.columns if c.lower() in names})


def shown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``columns``, those put aside under their own names again."""
    return df.select(*(df[_PREFIX + c].alias(c) if _PREFIX + c in df.columns else df[c] for c in columns))
