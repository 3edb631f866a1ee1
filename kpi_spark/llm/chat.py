"""Chat formatting after the collapse of cumulative snapshots.  DataFrame functions only.

Logs often hold a conversation once for each turn, every snapshot a prefix of the next.
:func:`maximal` keeps those conversations that no longer one extends, :func:`render`
writes each as one text.

1. Hashes of turns, never texts, are cut into ranges of (conversation, turn), so a conversation of
   any length spans as many tasks as it needs.  Turns are numbered within each range, with the counts of the
   conversation's ranges before as a carry; a running XOR of (number, role, text) hashes, carried the same
   way (XOR is associative), is the hash of each prefix, in two independent 64-bit halves, and that of the
   last turn is the conversation's own.
2. Of conversations with equal hashes the smallest id stays.  One whose hash is a proper
   prefix of another is found by a left anti-join against the distinct prefix hashes
   (pre-aggregated, so that a first turn that a third of all conversations share is one row).
3. Only the turns of what stays are gathered and rendered.  The rendered text of one conversation is
   one value, so it is bounded by what a value may hold (2 GB), and its task holds it.

Defined results: turns are ordered by turn (nulls first), then role, text; exactly repeated
rows count once; a null role is rendered as ``unknown``, a null text as empty, and both differ
from an empty string in the hashes; rows with a null conv_id are left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.llm.store import Tables


def prefixes(turns: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, n, h1, h2) of each prefix of each conversation."""
    own = turns.where("conv_id is not null").select(
        "conv_id",
        "turn",
        F.xxhash64(F.lit(1), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("x"),
        F.xxhash64(F.lit(2), F.col("text").isNull(), "text", F.col("role").isNull(), "role").alias("y"),
    )
    ranged = tables.put(own.distinct().repartitionByRange("conv_id", "turn", "x", "y").withColumn("part", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of a conversation's ranges
    local = Window.partitionBy("conv_id", "part")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    numbered = ranged.withColumn("local", F.row_number().over(local.orderBy(F.col("turn").asc_nulls_first(), "x", "y"))).join(before, ["conv_id", "part"])
    n = (F.col("before") + F.col("local")).cast("int")
    numbered = tables.put(numbered.select("conv_id", "part", n.alias("n"), F.xxhash64(n, "x").alias("x"), F.xxhash64(n, "y").alias("y")), "numbered")
    totals = numbered.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    carry = totals.select("conv_id", "part", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("tx", "ty")))
    run = local.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = numbered.select("conv_id", "part", "n", F.bit_xor("x").over(run).alias("x"), F.bit_xor("y").over(run).alias("y")).join(carry, ["conv_id", "part"])
    return summed.select("conv_id", "n", *(F.col(c).bitwiseXOR(F.col(f"t{c}")).alias(h) for c, h in (("x", "h1"), ("y", "h2"))))


def maximal(turns: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that stay."""
    seen = tables.put(prefixes(turns, tables), "prefixes")
    length = seen.groupBy("conv_id").agg(F.max("n").alias("n"))
    whole = seen.join(length, ["conv_id", "n"])
    unique = tables.put(whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")), "unique")
    proper = seen.join(length.withColumnRenamed("n", "whole"), "conv_id").where("n < whole").select("n", "h1", "h2").distinct()
    return unique.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of the kept conversations: ``<|role|>`` and the text of each turn, a line each."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct().join(kept, "conv_id")
    # the order that numbered the turns, by the same hashes
    key = F.struct(
        F.col("turn").isNotNull().alias("a"),
        F.col("turn").alias("b"),
        F.xxhash64(F.lit(1), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("x"),
        F.xxhash64(F.lit(2), F.col("text").isNull(), "text", F.col("role").isNull(), "role").alias("y"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("line"),
    )
    gathered = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(key)).alias("turns"))
    return gathered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("chat"))


def collapse(turns: DataFrame, tables: Tables) -> DataFrame:
    """The maximal conversations, rendered."""
    return render(turns, tables.put(maximal(turns, tables), "kept"))
