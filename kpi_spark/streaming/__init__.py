"""The period aggregation over a stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WINDOWS = {"D": "1 day", "W": "1 week"}


def aggregate_stream(stream: DataFrame, date: str, freq: str, values: Iterable[str], dims: Iterable[str] = (), late: str = "2 days") -> DataFrame:
    """(period, dims, sums) of daily or weekly (Monday) periods; rows later than ``late`` behind the newest are left out."""
    shift = "0 days" if freq == "D" else "4 days"  # windows are counted from a Thursday
    bucket = F.window(F.col(date), _WINDOWS[freq], startTime=shift)
    out = stream.withWatermark(date, late).groupBy(bucket.alias("w"), *dims).agg(*(F.sum(v).alias(v) for v in values))
    return out.select(F.col("w.start").cast("date").alias("period"), *dims, *values)
