"""Preparation of geo experiments: panel checks, eligible places, and a search for balanced designs.

The search (:func:`candidates`) is this library's own: places are cut into strata by
volume, each candidate assigns them by a hash of (place, seed, candidate), and designs
are ranked by how well the control series explains the treatment series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.operators.combine import incomplete
from kpi_spark.operators.filters import clean_places
from kpi_spark.operators.periods import consecutive, granularity

#: Places of a design search, at most.
PLACES = 2000


def kpi_check(df: DataFrame, kpi: str) -> DataFrame:
    """(rows, missing, not_numeric, zeros)."""
    value = F.col(kpi).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(value.isNull()).alias("missing"), F.count_if(value.isNotNull() & value.try_cast("double").isNull()).alias("not_numeric"), F.count_if(value.try_cast("double") == 0).alias("zeros"))


def panel(df: DataFrame, date: str, location: str, kpi: str) -> DataFrame:
    """(date, location, conversions) by day."""
    clean = clean_places(df, location)
    return clean.where(F.col(date).isNotNull()).groupBy(F.to_date(F.col(date)).alias("date"), F.col(location).alias("location")).agg(F.sum(F.col(kpi).try_cast("double")).alias("conversions"))


def panel_check(panel_: DataFrame, least: int = 7) -> DataFrame:
    """(days, granularity, gaps, incomplete, ok): daily, without gaps, complete and long enough."""
    grain = granularity(panel_, "date").select("granularity")
    gaps = consecutive(panel_, "date").select("days", "gaps")
    lacking = incomplete(panel_, "location", "date").agg(F.count(F.lit(1)).alias("incomplete"))
    out = gaps.crossJoin(grain).crossJoin(lacking)
    return out.withColumn("ok", (F.col("days") >= least) & (F.col("granularity") == "D") & (F.col("gaps") == 0) & (F.col("incomplete") == 0))


def eligible(panel_: DataFrame, fixed: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """(location, volume, fixed): places with volume that aren't excluded; fixed controls stay."""
    fixed, excluded = list(fixed), list(excluded)
    volume = panel_.groupBy("location").agg(F.sum("conversions").alias("volume"))
    return volume.where((F.col("volume") > 0) & ~F.col("location").isin(excluded)).withColumn("fixed", F.col("location").isin(fixed))


def place_findings(panel_: DataFrame, fixed: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """(location, finding): asked-for places that are unknown, or both fixed and excluded."""
    spark = panel_.sparkSession
    asked = spark.createDataFrame([(p, "fixed") for p in fixed] + [(p, "excluded") for p in excluded], "location string, list string")
    unknown = asked.select("location").distinct().join(panel_, "location", "left_anti").withColumn("finding", F.lit("unknown"))
    both = asked.groupBy("location").agg(F.count_distinct("list").alias("n")).where("n > 1").select("location", F.lit("fixed and excluded").alias("finding"))
    return unknown.unionByName(both)


def balance(volumes: DataFrame, group: str = "group") -> DataFrame:
    """(group, location, volume, share): each place's volume and its group's share of all."""
    everywhere = F.sum("volume").over(Window.partitionBy())
    return volumes.withColumn("share", F.sum("volume").over(Window.partitionBy(group)) / everywhere)


def assignments(designs: DataFrame) -> DataFrame:
    """(design, location, group): a long table of designs (design, treatment, control)."""
    long = lambda g: designs.select("design", F.explode(g).alias("location"), F.lit(g).alias("group"))
    return long("treatment").unionByName(long("control"))


def _gram(panel_: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each place over the days, and centred cross products of all places; a place's missing day counts as 0."""
    at = {name: i for i, name in enumerate(names)}
    places = panel_.sparkSession.createDataFrame(list(at.items()), "location string, i int")
    days = panel_.join(F.broadcast(places), "location").groupBy("date").agg(F.collect_list(F.struct("i", F.col("conversions").cast("double").alias("v"))).alias("row"))  # no more than the places
    p = len(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cross, sums, n = np.zeros((p, p)), np.zeros(p), 0
        for frame in frames:
            x = np.zeros((len(frame), p))
            for k, row in enumerate(frame["row"]):
                for cell in row:
                    x[k, cell["i"]] += cell["v"] or 0.0
            cross, sums, n = cross + x.T @ x, sums + x.sum(0), n + len(x)
        yield pd.DataFrame({"k": range(-1, p), "cells": [[n, *sums], *([0.0, *r] for r in cross)]})

    parts = days.mapInPandas(run, "k int, cells array<double>")
    rows = parts.groupBy("k").agg(F.array(*(F.sum(F.get("cells", F.lit(j))) for j in range(p + 1))).alias("cells")).collect()  # a row a place
    cells = {r["k"]: np.array(r["cells"], dtype=float) for r in rows}
    n, sums = cells[-1][0], cells[-1][1:]
    return sums, np.array([cells[k][1:] for k in range(p)]) - np.outer(sums, sums) / max(n, 1)


def candidates(
    panel_: DataFrame, places: DataFrame, n: int = 100_000, seed: int = 42, strata: int = 4, most_share: float = 0.30, least_r2: float = 0.80, slope_tolerance: float = 0.20, one_in: int = 2
) -> DataFrame:
    """(design, r2, slope, share, treatment, control), best first, of ``n`` hash-seeded assignments that meet the constraints.

    one_in: of each stratum's places that aren't fixed controls, one in so many is treated (with the fixed ones counted first).

    The series meet once, in the Gram matrix of the places (``PLACES`` at most, so it is bounded); the variances of a design's
    treatment and control series are quadratic forms of its 0/1 vector, evaluated for blocks of designs in tasks.
    Places' missing days count as 0.
    """
    order = Window.orderBy(F.desc("volume"), "location")  # one row a place
    known = places.select("location", F.col("volume").cast("double").alias("volume"), "fixed").withColumn("stratum", F.ntile(strata).over(order)).orderBy("location").limit(PLACES + 1).collect()
    if len(known) > PLACES:
        raise ValueError(f"at most {PLACES} places can be searched")
    spark, schema = panel_.sparkSession, "design int, r2 double, slope double, share double, treatment array<string>, control array<string>"
    if not known:
        return spark.createDataFrame([], schema)
    names, volume = [r["location"] for r in known], np.array([r["volume"] for r in known])
    fixed, stratum = np.array([r["fixed"] for r in known]), np.array([r["stratum"] for r in known])
    sums, cross = _gram(panel_, names)
    shared = spark.sparkContext.broadcast((names, volume, fixed, stratum, sums, cross))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, volume, fixed, stratum, sums, cross = shared.value
        for batch in batches:
            h = np.asarray(batch.column("h").flatten()).reshape(len(batch), len(names))
            treated = np.zeros(h.shape, dtype=bool)
            for k in np.unique(stratum):
                free = np.flatnonzero((stratum == k) & ~fixed)
                place = np.argsort(np.argsort(h[:, free], axis=1), axis=1) + 1 + np.count_nonzero((stratum == k) & fixed)
                treated[:, free] = place % one_in == 0
            t, c = treated.astype(float), 1.0 - treated
            tt, cc, tc = (np.einsum("ij,ij->i", x @ cross, y) for x, y in ((t, t), (c, c), (t, c)))
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where(cc > 0, np.where(tt > 0, tc * tc / (tt * cc), 1.0), np.nan)
                slope = tc / cc * (c @ sums) / (t @ sums)
                share = t @ volume / volume.sum()
                good = np.flatnonzero((share <= most_share) & (r2 >= least_r2) & (np.abs(slope - 1) <= slope_tolerance))
            groups = [[[names[i] for i in np.flatnonzero(x[k] > 0)] for k in good] for x in (t, c)]
            yield pa.RecordBatch.from_arrays([batch.column("design").take(pa.array(good)), *(pa.array(v[good], pa.float64()) for v in (r2, slope, share)), *(pa.array(g, pa.list_(pa.string())) for g in groups)], names=["design", "r2", "slope", "share", "treatment", "control"])

    designs = spark.range(1, n + 1).select(F.col("id").cast("int").alias("design"))
    drawn = designs.select("design", F.transform(F.array(*map(F.lit, names)), lambda p: F.xxhash64(p, F.lit(seed), F.col("design"))).alias("h"))
    return drawn.mapInArrow(run, schema).orderBy(F.desc("r2"), "design")
