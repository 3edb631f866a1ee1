"""User analyses: table functions with a declared input shape and parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kpi_spark.functions.typing import date_columns, numeric_columns


@dataclass(frozen=True)
class Analysis:
    """A named function from a table and parameters to several tables, and what it needs."""

    name: str
    run: Callable[..., dict[str, DataFrame]]
    description: str = ""
    category: str = ""
    dates: int = 0
    metrics: int = 0
    dimensions: int = 0
    parameters: dict[str, object] = field(default_factory=dict)

    def problems(self, df: DataFrame) -> list[str]:
        """What the table lacks."""
        have = {"dates": len(date_columns(df)), "metrics": len(numeric_columns(df)), "dimensions": len(df.columns) - len(numeric_columns(df)) - len(date_columns(df))}
        return [f"{kind}: {n} needed, {have[kind]} found" for kind, n in (("dates", self.dates), ("metrics", self.metrics), ("dimensions", self.dimensions)) if have[kind] < n]

    def options(self, df: DataFrame) -> dict[str, list[str]]:
        """The columns each kind of parameter can name."""
        dates, numbers = date_columns(df), numeric_columns(df)
        return {"dates": dates, "metrics": numbers, "dimensions": [c for c in df.columns if c not in dates and c not in numbers]}


_ANALYSES: dict[str, Analysis] = {}


def register(analysis: Analysis) -> Analysis:
    _ANALYSES[analysis.name] = analysis
    return analysis


def names() -> list[str]:
    return sorted(_ANALYSES)


def execute(name: str, df: DataFrame, **parameters) -> dict[str, DataFrame]:
    """Runs a registered analysis; an error names what the table lacks."""
    analysis = _ANALYSES[name]
    if problems := analysis.problems(df):
        raise ValueError(f"{name}: {'; '.join(problems)}")
    return analysis.run(df, **{**analysis.parameters, **parameters})
