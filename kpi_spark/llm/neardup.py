"""Near-duplicates by b-bit MinHash.

:func:`groups` gives each document its shingle count and the smallest id of the group
it belongs to; :func:`dedup` keeps one document of each group.

1. One pass over the texts makes each document's sketch: the digest of its shingle set,
   band hashes of its minima, and the low two bits of 512 (mixed) minima, packed in longs.
   Documents of equal sets form a class, represented by its smallest id; only
   representatives go on, so copies never meet each other.
2. Band keys shared by several representatives are buckets.  Members are paired with
   two hubs of their bucket; of the pairs whose collision-corrected similarity, by bit
   counts of the packed bits, can reach the threshold the best ones of each member are
   verified on the full sets (64-bit hashes of all shingles, from another pass that a
   Bloom filter of the ids narrows).  The verified links' components follow.
3. What hubs leave apart: members of buckets that still hold several components get a
   longer sketch (2048 slots), and are compared across components (bits only, inside the
   join, the longer ones where the first let a pair through, each pair in the first bucket
   that it shares) and verified like those.  Pairs inside a component are never
   formed, and no link between different texts is given up.  A bucket of very many open
   members is shared out to a grid of tasks, one for ``PART`` of them, so its rows are copied as
   often as the grid has rows, and not as often as it has tasks.  Where very many pairs are
   open, the best one of each member and other component goes first.

Bands are as many as leave a link at the threshold unseen with a chance under ``MISS``;
bits reject one with about 3e-6, the longer ones with as much again.

Defined results: texts that are null or have no words have an empty set and are linked
with nothing; a null id belongs to no group (component null) and stays in
:func:`dedup`; rows that repeat an id are one document, linked if any of its texts is;
ids are whole numbers (other types are cast to long, and an id that is none is an error);
other columns pass through :func:`dedup` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpi_spark.llm import bloom
from kpi_spark.llm import kernels as K
from kpi_spark.llm.components import components, merged
from kpi_spark.llm.store import Tables

#: Chance to miss a link at the threshold by all bands; standard deviations below it at which the bits still let a pair through.
MISS, SLACK = 1e-6, 4.5
#: From this many open pairs on, only the best of each member and component is verified first.
MANY = 150_000
#: Rows (texts, or pairs of sets) that go to Python at once.
BATCH = 1000
#: Open members of a bucket that one task compares with the rest of it.
PART = 2000


@dataclass(frozen=True)
class Scheme:
    """Sketches of ``slots`` minima: ``bits`` bits of each (mixed) one from bit ``shift`` on, and bands of ``rows`` of them.

    seed: of the permutations.  label: what the columns' names begin with.
    """

    slots: int
    bits: int
    rows: int
    shift: int = 0
    seed: int = 1
    label: str = "s"

    @property
    def names(self) -> list[str]:
        """The columns of the packed bits."""
        return [f"{self.label}{i}" for i in range(self.slots * self.bits // 64)]

    def bands(self, threshold: float) -> int:
        return min(self.slots // self.rows, math.ceil(math.log(MISS) / math.log(1 - threshold**self.rows)))

    def least(self, threshold: float) -> int:
        """Slots that must agree: the collision-corrected expectation at the threshold, less the slack."""
        c = threshold + (1 - threshold) / 2**self.bits
        return math.floor(self.slots * c - SLACK * math.sqrt(self.slots * c * (1 - c)))

    def lanes(self, minima: np.ndarray) -> np.ndarray:
        """The bits kept of each minimum."""
        return (K.mix(minima) >> np.uint64(self.shift)) & np.uint64(2**self.bits - 1)

    def packed(self, lanes: np.ndarray) -> np.ndarray:
        """Lanes side by side in longs; rows x longs."""
        each = 64 // self.bits
        parts = lanes.reshape(len(lanes), len(self.names), each)
        return np.bitwise_or.reduce(parts << (np.arange(each, dtype=np.uint64) * np.uint64(self.bits)), axis=2)

    def keys(self, minima: np.ndarray, bands: int) -> np.ndarray:
        """Band hashes: of the lanes where these tell minima apart, else of the minima."""
        parts = (self.lanes(minima) if self.bits >= 16 else minima)[:, : bands * self.rows].reshape(len(minima), bands, self.rows)
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
        for r in range(self.rows):
            out = K.mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
        return out

    def agreeing(self, x: str, y: str) -> Column:
        """Slots in which two packed sketches agree, by bit counts."""
        ones = sum(1 << i for i in range(0, 64, self.bits))  # the lowest bit of each lane
        differ = F.lit(0)
        for s in self.names:
            z = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
            fold = self.bits
            while fold > 1:
                fold //= 2
                z = z.bitwiseOR(F.shiftrightunsigned(z, fold))
            differ = differ + F.bit_count(z.bitwiseAND(F.lit(ones)))
        return F.lit(self.slots) - differ


#: b-bit MinHash: two bits of each of 512 minima, bands of six.
B_BIT = Scheme(512, 2, 6)
#: Bits of more minima, for members of buckets that hubs leave apart; they have no bands.
LONGER = Scheme(2048, 2, 6, seed=2, label="m")


def row_sets(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and where each row's begin."""
    values, begin = K.shingles(words, first, size)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[begin[:-1][begin[:-1] < len(values)]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return values[new], kept[begin]


def digests(values: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    """A sum of each row's mixed values; 0 for rows without."""
    out = np.zeros(len(begin) - 1, np.uint64)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        out[some] = np.add.reduceat(K.mix(values ^ np.uint64(salt)), begin[some])
    return out


def _digests(values: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    """The two digests of each row's set."""
    return [pa.array(digests(values, begin, s).view(np.int64)) for s in (0, 0x5BD1E995)]


def _sketches(docs: DataFrame, shingle: int, bands: int, scheme: Scheme) -> DataFrame:
    schema = "doc_id long, n_shingles long, d1 long, d2 long, " + ", ".join(f"{s} long" for s in scheme.names) + ", bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = K.Permutations(scheme.slots, scheme.seed)
        for batch in batches:
            buf, off = K.text_buffer(batch.column("text"))
            for i, j in K.pieces(off):
                values, begin = row_sets(*K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], K.NONSPACE), shingle)
                minima = permutations.minima(values, begin)
                bits, keys = scheme.packed(scheme.lanes(minima)).view(np.int64), scheme.keys(minima, bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(begin)), *_digests(values, begin), *(pa.array(np.ascontiguousarray(b)) for b in bits.T), lists],
                    ["doc_id", "n_shingles", "d1", "d2", *scheme.names, "bands"],
                )

    return docs.mapInArrow(run, schema)


def _of_some(docs: DataFrame, ids: DataFrame, shingle: int, schema: str, made: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """doc_id and what is made of the shingle sets (hashes, first of each row) of the documents whose id may be among ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(F.col("node"), ids))
    names = ["doc_id", *(column.split()[0] for column in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.flatnonzero(bloom.maybe(shared.value, np.asarray(batch.column("h"))))
            batch = batch.take(pa.array(wanted))
            buf, off = K.text_buffer(batch.column("text"))
            for i, j in K.pieces(off):
                out = made(*row_sets(*K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], K.NONSPACE), shingle))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *out], names)

    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, f"doc_id long, {schema}")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles: binary, sorted 64-bit hashes) of the documents whose id may be among ``ids``."""

    def made(values: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
        return [pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * 8).astype(np.int32)), pa.py_buffer(values)])]

    return _of_some(docs, ids, shingle, "shingles binary", made)


def _longer(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, d1, d2: digests of the set, the bits of ``LONGER``) of the documents whose id may be among ``ids``."""

    def made(values: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
        bits = LONGER.packed(LONGER.lanes(K.Permutations(LONGER.slots, LONGER.seed).minima(values, begin))).view(np.int64)
        return [*_digests(values, begin), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)]

    return _of_some(docs, ids, shingle, "d1 long, d2 long, " + ", ".join(f"{s} long" for s in LONGER.names), made)


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, share: int, tables: Tables, label: str) -> DataFrame:
    """The pairs (a, b, and the components p and q of the two) whose full sets' similarity is at least ``share`` percent; a pair may come twice."""
    ids = tables.put(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{label}-ids", rows=2 * pairs.count())
    sets = tables.put(_sets(docs, ids, shingle), f"{label}-sets", BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) >= share * max(len(x), len(y)):
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep[k] = 100 * common >= share * (len(x) + len(y) - common) > 0
            yield batch.select(["a", "b", "p", "q"]).filter(pa.array(keep))
        pa.default_memory_pool().release_unused()  # the worker outlives the task

    side = lambda key, name: sets.select(F.col("doc_id").alias(key), F.col("shingles").alias(name))
    joined = pairs.select("a", "b", "p", "q").join(side("a", "x"), "a").join(side("b", "y"), "b")
    out = tables.put(joined.mapInArrow(run, "a long, b long, p long, q long"), f"{label}-links", BATCH)
    tables.drop(f"{label}-sets", f"{label}-ids")
    return out


def groups(docs: DataFrame, tables: Tables, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", scheme: Scheme = B_BIT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; links are pairs of at least ``percent`` percent similarity."""
    sketches, labels = _labelled(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tables, shingle, percent, scheme)
    out = sketches.select("doc_id", "n_shingles", "d1", "d2").join(labels, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(docs: DataFrame, tables: Tables, shingle: int, percent: int, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """The written sketches, and the component of each class of equal sets."""
    threshold, bits = percent / 100, scheme.names
    sketches = tables.put(_sketches(docs, shingle, scheme.bands(threshold), scheme), "sketches", BATCH)
    classes = tables.put(sketches.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = tables.put(sketches.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]), "reps")
    sketch = reps.select(F.col("doc_id").alias("node"), "bands", *bits)
    keys = tables.put(reps.select(F.posexplode("bands").alias("band", "key"), F.col("doc_id").alias("node")), "keys")
    # a bucket's hubs: its smallest id, and the id next to the key by XOR, which is another one in each band
    hubs = tables.put(
        keys.groupBy("key").agg(F.min("node").alias("hub"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("other"), F.max("node").alias("last")).where("hub < last").select("key", "hub", F.col("other").bitwiseXOR(F.col("key")).alias("other")),
        "hubs",
    )
    members = tables.put(keys.join(hubs, "key"), "members")
    tables.drop("keys", "hubs")
    enough = scheme.least(threshold)
    pair = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    spokes = members.select(*pair("node", "hub")).union(members.select(*pair("node", "other"))).where("a < b").distinct()
    x, y = (sketch.select(F.col("node").alias(k), *bits).alias(k) for k in "ab")
    close = spokes.join(x, "a").join(y, "b").select("a", "b", scheme.agreeing("a", "b").alias("agreeing")).where(F.col("agreeing") >= enough)
    close = tables.put(close, "close")
    n = close.count()
    # each end's best partner is enough to bring most of a group together
    ends = close.union(close.select("b", "a", "agreeing")).groupBy("a").agg(F.max_by("b", F.struct("agreeing", "b")).alias("b"))
    tried = tables.put(ends.select(*pair("a", "b")).distinct(), "tried-0", rows=2 * n)
    links = _verified(tried.withColumn("p", F.col("a")).withColumn("q", F.col("b")), docs, shingle, percent, tables, "round-0")
    found = tables.put(components(links, tables, "cc-0", 2 * n), "components-0", rows=4 * n)
    # then the best pair of each member and each other component
    place = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))
    apart = close.join(place("a"), "a", "left").join(place("b"), "b", "left").select("a", "b", "agreeing", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")).where("of_a <> of_b")
    ends = apart.union(apart.select("b", "a", "agreeing", "of_b", "of_a")).groupBy("a", "of_a", "of_b").agg(F.max_by("b", F.struct("agreeing", "b")).alias("b"))
    between = lambda p, q: (F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    more = tables.put(ends.select(*pair("a", "b"), *between("of_a", "of_b")).distinct().join(tried, ["a", "b"], "left_anti"), "more-0", rows=2 * n)
    tried = tried.union(more.select("a", "b"))
    found = merged(found, _verified(more, docs, shingle, percent, tables, "round-0b"), tables, "cc-0b")
    k, size = 0, members.count()
    while True:
        k += 1
        placed = tables.put(members.select("key", "band", "node").join(found, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component")), f"placed-{k}", rows=size)
        # the component of most members of a bucket is compared with the others only
        sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        shared = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all"), F.max("size").alias("most"))
        open_keys = shared.where("parts > 1").select("key", "main", F.ceil((F.col("all") - F.col("most")) / PART).cast("int").alias("deal"))
        waiting = tables.put(placed.join(tables.put(open_keys, f"main-{k}", rows=size), "key"), f"waiting-{k}", rows=size)
        if waiting.isEmpty():
            break
        if k == 1:  # later rounds' open buckets are among these
            apart = tables.put(waiting.select("node").distinct(), "apart", rows=size)
            bits_of = tables.put(_longer(docs, apart, shingle), "longer", BATCH).dropDuplicates(["doc_id", "d1", "d2"])
            both = tables.put(reps.join(bits_of, ["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("node"), "bands", *bits, *LONGER.names), "both")
        open_ = tables.put(waiting.join(both, "node"), f"open-{k}")
        # a grid of tasks: open members are cut one way, all members the other, so a row goes to a row or a column of it only
        side = F.ceil(F.sqrt("deal")).cast("int")
        own = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "node"), side).cast("int")
        every = F.explode(F.sequence(F.lit(0), side - 1))
        x = open_.where("component <> main").withColumn("row", own(1)).withColumn("column", every).alias("x")
        y = open_.withColumn("column", own(2)).withColumn("row", every).alias("y")
        across = (F.col("x.key") == F.col("y.key")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.column") == F.col("y.column")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.col("x.band") + 1
        pairs = x.join(y, across & (scheme.agreeing("x", "y") >= enough) & (LONGER.agreeing("x", "y") >= LONGER.least(threshold)) & first).select(
            *pair("x.node", "y.node"), *between("x.component", "y.component"), scheme.agreeing("x", "y").alias("agreeing")
        )
        pairs = tables.put(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), f"left-{k}")
        rows = pairs.count()
        if not rows:
            break
        if best := rows > MANY:
            pairs = tables.put(pairs.groupBy("a", "p", "q").agg(F.max_by("b", F.struct("agreeing", "b")).alias("b")), f"best-{k}", rows=rows)
        found = merged(found, _verified(pairs, docs, shingle, percent, tables, f"round-{k}"), tables, f"cc-{k}")
        tables.drop(f"placed-{k}", f"main-{k}", f"waiting-{k}", f"open-{k}")
        if not best:  # every pair across components has been tried
            break
        tried = tables.put(tried.select("a", "b").union(pairs.select("a", "b")), f"tried-{k}")
    labels = tables.put(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component")), "labels")
    tables.keep("sketches", "labels")
    return sketches, labels


def dedup(docs: DataFrame, tables: Tables, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for (the one of the smallest id)."""
    gone = groups(docs, tables, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
