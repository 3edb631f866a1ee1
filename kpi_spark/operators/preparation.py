"""Data made ready for an analysis: event columns, destinations and numeric KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpi_spark.functions import typing as typ
from kpi_spark.operators.filters import map_codes
from kpi_spark.operators.its import Its
from kpi_spark.operators.linear import Fit
from kpi_spark.operators.periods import event_columns

#: Event labels at most: each becomes a column.
LABELS = 500


def event_labels(events: DataFrame) -> list[str]:
    """The labels of a list of events: its groups, and the names of those that stand on their own."""
    label = F.when(F.col("own"), F.col("name")).otherwise(F.col("grp")).alias("label")
    found = [r["label"] for r in events.select(label).where("label is not null").distinct().orderBy("label").limit(LABELS + 1).collect()]
    if len(found) > LABELS:
        raise ValueError(f"more than {LABELS} event labels")
    return found


def for_regression(df: DataFrame, events: DataFrame, date: str) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for each event label, and those columns' names."""
    labels = event_labels(events)
    return event_columns(df, events, date, labels), labels


def for_impact(df: DataFrame, events: DataFrame, date: str, kpis: Sequence[str], mapping: DataFrame | None = None, code: str | None = None, destination: str = "destination") -> DataFrame:
    """``df`` with the destination of its ``code`` (where it has none yet), numeric KPIs and event columns; a KPI that would lose values is an error."""
    if mapping is not None and code is not None and destination not in df.columns:
        df = map_codes(df, code, mapping, destination)
    text = [c for c in kpis if c in typ.text_columns(df)]
    if text:
        parsed = {c: F.col(c).try_cast("double") for c in text}
        whole = df.agg(*(typ.lossless(F.col(c), parsed[c]).alias(f"l{i}") for i, c in enumerate(text))).first()
        if bad := [c for i, c in enumerate(text) if not whole[f"l{i}"]]:
            raise ValueError(f"valores no numéricos: {', '.join(bad)}")
        df = df.withColumns(parsed)
    return for_regression(df, events, date)[0]


def with_event_effect(fit: Fit, df: DataFrame, its: Its, period: str) -> DataFrame:
    """Rows with prediction, residual and contributions, and the event's effect on their period (null before it)."""
    effects = its.effects().withColumnsRenamed({c: f"event_{c}" for c in ("effect", "low", "high", "cumulative", "cumulative_low", "cumulative_high")})
    return fit.augmented(df).join(effects.withColumnRenamed("period", "_period"), F.col(period) == F.col("_period"), "left").drop("_period")
