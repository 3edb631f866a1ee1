"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces links by links to smaller nodes, until every node links to the
smallest one of its component; the number of rounds grows with the logarithm of the
component's size.  Minima are pre-aggregated before their shuffle, and both sides of
each join are read from written tables, so that AQE can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpi_spark.llm.store import Tables, few_tasks


def _stars(links: DataFrame, n: int) -> bool:
    """Whether every node links to one other only, which links to none."""
    ends = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return few_tasks(ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1"), 2 * n).isEmpty()


def components(links: DataFrame, tables: Tables, label: str = "cc", rows: int | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); component is its smallest node.

    Nulls and loops are left out; repeated links count once; no links give no rows.
    rows: how many links there are at most, where that is known.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = tables.put(links, f"{label}-0", rows=rows)
    n, k = links.count(), 0
    while not _stars(links, n):
        k += 1
        both = links.union(links.select("b", "a"))
        least = tables.put(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{label}-{k}m", rows=2 * n)
        large = tables.put(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{label}-{k}l", rows=2 * n)
        least = tables.put(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-{k}n", rows=2 * n)
        joined = large.join(least, "a")
        links = tables.put(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", "m")).distinct(), f"{label}-{k}", rows=2 * n)
        tables.drop(f"{label}-{k}m", f"{label}-{k}l", f"{label}-{k}n", f"{label}-{k - 1}")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def merged(found: DataFrame, links: DataFrame, tables: Tables, label: str = "cc") -> DataFrame:
    """The components ``found`` (node, component), joined by further links (p, q) between components.

    A node that isn't in ``found`` is a component of its own, named by itself.
    """
    if not (n := links.count()):
        return found
    more = tables.put(components(links.select(F.col("p").alias("a"), F.col("q").alias("b")), tables, label, n), f"{label}-more", rows=2 * n)
    joined = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = more.join(found.select("node"), "node", "left_anti")
    return tables.put(joined.select("node", F.coalesce("to", "component").alias("component")).union(alone.select("node", "component")), f"{label}-merged", rows=found.count() + 2 * n)
