"""The trie of conversations' prefixes, with totals of its subtrees by centroid decomposition.

:func:`prefix_trie` gives a row for each distinct sequence of first turns (role and text) of rebuilt
conversations; :func:`rollup` adds up values over the subtrees of any forest of parent edges.

1. Turns get their place by ranges of (conversation, turn) with a carry, so one conversation may
   span many tasks; only digests of turns move, never texts.
2. A prefix's key is a running XOR, in two independent 64-bit halves, of hashes of (place, turn), by blocks
   of ``BLOCK`` places with a carry.  Nodes are groups of equal keys, pre-aggregated.
3. ``rollup``: the forest falls into components small enough for a task by taking out separators
   (nodes at which the subtree's size passes a multiple of ``LIMIT`` that no child's reaches;
   sizes and components' tops are found by pointer doubling).  The separators form a much smaller forest with
   the components' totals as values, and go through the same function.  Tasks then split
   their components level by level at centroids: a centroid's subtree within its component is the
   component's total less that of the part above it, and is added to the nodes on
   the path from the centroid to the component's top.  Each node is on few such paths, whatever the depth.
4. Ids of conversations that end at a node are sorted by ranges, joined by the range,
   and hashed as a stream, so no node's ids are gathered.

Defined results: turns are ordered by turn (nulls first), equal ones by an MD5 digest of role and
text; rows that repeat each count as a turn; a null role or text is empty; rows with a null conv_id are
left out, and ids are cast to long; without any conversation there are no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpi_spark.llm.store import Tables

#: Nodes of a task, places of a block, conversations whose ids share a base, and turns that may be replaced (less one).
LIMIT, BLOCK, FAMILY, HEADS = 100_000, 1024, 100, 6
ROOT = "root"


# -- conversations ---------------------------------------------------------------------------------


def placed(turns: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, place, digest, n_chars) of each turn; places count from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), F.length(text).cast("long").alias("n_chars")
    )
    ranged = tables.put(own.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return ranged.withColumn("local", local).join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("local")).alias("place"), "digest", "n_chars")


def rebuilt(turns: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Turns after each conversation's first h, h = crc32(id) % ``HEADS``, became those of its family's base (id - id % ``FAMILY``).

    Returns the turns and (conv_id, depth) of each conversation, those without turns too.
    """
    own = tables.put(placed(turns, tables), "placed")
    sizes = tables.put(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = tables.put(convs, "convs")
    first = own.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    heads = convs.where("head > 0").select("conv_id", "base", "head").join(first, "base").where("place <= head").select("conv_id", "place", "digest", "n_chars")
    tails = own.join(convs.where("n > h").select("conv_id", "h", "head"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "digest", "n_chars")
    return heads.unionByName(tails), convs.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))


def _key(depth: Column, x: Column, y: Column) -> Column:
    return F.when(depth > 0, F.concat_ws("-", depth.cast("string"), F.hex(x), F.hex(y))).otherwise(F.lit(ROOT))


def prefixes(turns: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, depth, node, parent, n_chars) of each prefix but the empty one of each conversation; turns: conv_id, place, digest, n_chars."""
    block = ((F.col("place") - 1) / BLOCK).cast("long")
    own = tables.put(turns.select("*", block.alias("block"), F.xxhash64(F.lit(1), "place", "digest").alias("x"), F.xxhash64(F.lit(2), "place", "digest").alias("y")), "turns")
    totals = own.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("bx", "by")))
    inner = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = own.select("*", F.bit_xor("x").over(inner).alias("rx"), F.bit_xor("y").over(inner).alias("ry")).join(carry, ["conv_id", "block"])
    hx, hy = F.col("rx").bitwiseXOR(F.col("bx")), F.col("ry").bitwiseXOR(F.col("by"))
    return run.select("conv_id", F.col("place").alias("depth"), _key(F.col("place"), hx, hy).alias("node"), _key(F.col("place") - 1, hx.bitwiseXOR(F.col("x")), hy.bitwiseXOR(F.col("y"))).alias("parent"), "n_chars")


def hashed_ids(ends: DataFrame, tables: Tables) -> DataFrame:
    """(node, ends_sha256): SHA-256 of each node's conv_ids as decimals, in ascending order, comma-joined; ends: (node, conv_id)."""
    ranged = tables.put(ends.repartitionByRange("node", "conv_id").withColumn("part", F.spark_partition_id()), "ends")
    parts = ranged.groupBy("node", "part").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))  # no more than a range holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[str, str]] = []
            for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if now == node:
                    state.update(b",")
                elif node is not None:
                    done.append((node, state.hexdigest()))
                if now != node:
                    node, state = now, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(run, "node string, ends_sha256 string")


# -- totals of subtrees ----------------------------------------------------------------------------


def _tops(up: np.ndarray) -> np.ndarray:
    """The top above each node; ``up`` is -1 at tops."""
    at = np.where(up < 0, np.arange(len(up)), up)
    while not np.array_equal(at, further := at[at]):
        at = further
    return at


def _sizes(up: np.ndarray) -> np.ndarray:
    """Nodes of each subtree, by pointer doubling."""
    size = np.ones(len(up), dtype=np.int64)
    while (some := np.flatnonzero(up >= 0)).size:
        more = np.zeros_like(size)
        np.add.at(more, up[some], size[some])
        size += more
        up = np.where(up >= 0, up[up], -1)
    return size


def centroid_sums(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (nodes x columns) over each node's subtree; parent: index of each node's parent, -1 without one.

    All components are split at once, level by level; there are no more levels than bits in the number of nodes.
    """
    n, up = len(parent), parent.astype(np.int64)
    out, extra, removed = np.zeros_like(values), np.zeros_like(values), np.zeros(n, dtype=bool)
    size, alive = _sizes(up), np.arange(n)
    top = _tops(up)
    while len(alive):
        inside = np.zeros_like(values)
        np.add.at(inside, top[alive], values[alive])
        heavy = alive[2 * size[alive] >= size[top[alive]]]  # a path down from each top; its lowest node is the centroid
        heavy = heavy[np.lexsort((size[heavy], top[heavy]))]
        centroid = heavy[np.flatnonzero(np.diff(top[heavy], prepend=-1))]
        own_top, above = top[centroid], up[centroid]
        removed[centroid] = True
        alive = alive[~removed[alive]]
        up[alive[(up[alive] >= 0) & removed[up[alive]]]] = -1
        top = _tops(np.where(removed, -1, up))
        rest = np.zeros_like(values)
        np.add.at(rest, top[alive], values[alive])
        total = inside[own_top] - np.where((own_top != centroid)[:, None], rest[own_top], 0)
        out[centroid] = extra[centroid] + total
        less = size[centroid]
        while (on := np.flatnonzero(above >= 0)).size:  # one step up the paths of all components
            above, total, less = above[on], total[on], less[on]
            extra[above] += total
            size[above] -= less
            above = up[above]
    return out


def _in_tasks(forest: DataFrame, values: list[str], buckets: int) -> DataFrame:
    """Totals where each component (equal ``top``) lies in one bucket; parents outside it count as none."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_pandas()
        parent = pd.Index(nodes).get_indexer(table["parent"].to_pandas().fillna(""))
        sums = centroid_sums(parent, np.column_stack([table[v].to_numpy() for v in values]))
        return pa.table([table["node"], *(pa.array(sums[:, k]) for k in range(len(values)))], names=["node", *values])

    bucket = F.pmod(F.xxhash64("top"), F.lit(buckets)) if buckets > 1 else F.lit(0)
    return forest.groupBy(bucket.alias("bucket")).applyInArrow(run, ", ".join(["node string", *(f"{v} long" for v in values)]))


def subtree_sizes(forest: DataFrame, tables: Tables, label: str = "rollup") -> DataFrame:
    """(node, size) by pointer doubling: as many rounds as bits in the depth."""
    now, k = tables.put(forest.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), f"{label}-size-0"), 0
    while not now.where("up is not null").isEmpty():
        k += 1
        more = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        above = now.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"))
        now = now.join(more, "node", "left").join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        now = tables.put(now, f"{label}-size-{k}")
        tables.drop(f"{label}-size-{k - 1}")
    return now.select("node", "size")


def _labelled(forest: DataFrame, tables: Tables, label: str) -> DataFrame:
    """``forest`` (node, parent, cut) with the top of each node's component; separators (cut) have none."""
    cuts = forest.where("cut").select(F.col("node").alias("parent"), F.lit(True).alias("below"))
    start = forest.where("not cut").join(cuts, "parent", "left").select("node", F.when(F.col("parent").isNull() | F.col("below").isNotNull(), F.col("node")).otherwise(F.col("parent")).alias("top"))
    now, k = tables.put(start, f"{label}-top-0"), 0
    while True:
        k += 1
        above = now.where("top <> node").select(F.col("node").alias("top"), F.col("top").alias("next"))  # tops stay where they are
        further = tables.put(now.join(above, "top", "left").select("node", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")), f"{label}-top-{k}")
        tables.drop(f"{label}-top-{k - 1}")
        now = further.select("node", "top")
        if further.where("moved").isEmpty():
            return now


def rollup(forest: DataFrame, values: list[str], tables: Tables, limit: int = LIMIT, label: str = "rollup") -> DataFrame:
    """(node, *values): the values (long) of each node's whole subtree; forest: a written table of node, parent (strings; null or none of the nodes at tops) and the values.

    limit: nodes that a task holds; at least 2.
    """
    n = forest.count()
    if n <= limit:
        return _in_tasks(forest, values, 1)
    sized = tables.put(forest.join(subtree_sizes(forest, tables, label), "node").withColumn("q", F.floor(F.col("size") / limit)), f"{label}-sized")
    passed = sized.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.max("q").alias("below"))
    marked = tables.put(sized.join(passed, "node", "left").withColumn("cut", F.col("q") > F.coalesce("below", F.lit(0))).select("node", "parent", *values, "cut"), f"{label}-marked")
    tops = _labelled(marked, tables, label)
    inner = tables.put(marked.where("not cut").join(tops, "node").select("node", "parent", "top", *values), f"{label}-inner")
    # the separators' forest: a component's total goes to the separator above its top
    above = inner.where("node = top").select("top", F.col("parent").alias("above"))
    totals = inner.groupBy("top").agg(*(F.sum(v).alias(v) for v in values)).join(above, "top").groupBy(F.col("above").alias("node")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    hangs = inner.join(above, "top").select(F.col("node").alias("parent"), "above", F.lit(True).alias("inside"))
    cuts = marked.where("cut").join(totals, "node", "left").join(hangs, "parent", "left")
    cuts = tables.put(cuts.select("node", F.when(F.col("inside"), F.col("above")).otherwise(F.col("parent")).alias("parent"), F.col("parent").alias("at"), "inside", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)), f"{label}-cuts")
    upper = tables.put(rollup(cuts.select("node", "parent", *values), values, tables, limit, f"{label}-up"), f"{label}-upper")
    # and a separator's total hangs at the node above it in its component
    hung = upper.join(cuts.where("inside").select("node", "at"), "node").groupBy(F.col("at").alias("node")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    inner = inner.join(hung, "node", "left").select("node", "parent", "top", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
    return _in_tasks(inner, values, -(-n // limit)).unionByName(upper)


def prefix_trie(turns: DataFrame, tables: Tables, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    new, convs = rebuilt(turns, tables)
    convs, all_ = tables.put(convs, "depths"), tables.put(prefixes(new, tables), "prefixes")
    of = all_.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("n_convs"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    of = of.unionByName(root.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("n_chars"), "n_convs"))
    nodes = tables.put(of, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = tables.put(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "parents")
    forest = tables.put(nodes.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens")), "forest")
    ends = all_.join(convs, ["conv_id", "depth"]).select("node", "conv_id").unionByName(convs.where("depth = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left").join(rollup(forest, ["n_leaves", "saved_tokens"], tables, limit), "node").join(hashed_ids(ends, tables), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
