"""Document fingerprints by MinHash.

:func:`fingerprints` adds to each row a fingerprint of its text: for each of ``SLOTS``
universal hash permutations the smallest image of its distinct five-word shingles,
computed for many texts at once with numpy, 16 (mixed) bits of it as four hex digits.
:func:`likeness` is the share of slots in which two of them agree, an estimate of the
Jaccard similarity.  :func:`with_edits` also fingerprints each document with its last
quarter replaced by the beginning of the next document.  :func:`similar_groups` joins bands
of four slots of these fingerprints in Spark and verifies the Jaccard similarity of what
meets there on the full shingle sets.

The next document is the one of the next larger id (after the last one: the first).
Ids are cut into ranges at quantiles; each range's rows, with one guest (the smallest row
of the range behind it, added by a small table of each range's smallest id), are dealt
to tasks by the range and walked in the order of ids, so each text crosses the network
once and no task holds more than a batch.

Defined results: null and empty texts have no shingles, all slots ``ffff``, and are like each
other (1) and unlike all else (0); rows that repeat an id follow each other in the order of
their texts; rows with a null id get fingerprints of their own text, and no edited or next
one (null); an only document is its own next one; ids are whole numbers (other types are cast
to long, and an id that is none is an error); other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpi_spark.llm import kernels as K
from kpi_spark.llm import neardup
from kpi_spark.llm.store import Tables

#: Permutations, words of a shingle, rows of text walked at once, and documents of a range of ids.
SLOTS, SHINGLE, ROWS, RANGE = 128, 5, 256, 1000
#: Ranges at most (their smallest ids are known to every task).
RANGES = 20_000


def signatures(permutations: K.Permutations, texts: pa.Array) -> np.ndarray:
    """Rows x SLOTS numbers of 16 bits."""
    buf, off = K.text_buffer(texts)
    out = [np.zeros((0, SLOTS), np.uint16)]
    for i, j in K.pieces(off):
        values, begin = K.shingles(*K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], K.NONSPACE), SHINGLE)
        minima = permutations.minima(values, begin)
        short = (K.mix(minima) >> np.uint64(48)).astype(np.uint16)
        short[np.diff(begin) == 0] = 0xFFFF
        out.append(short)
    return np.concatenate(out)


def hexed(signatures_: np.ndarray) -> list[str]:
    whole = signatures_.astype(">u2").tobytes().hex()
    return [whole[i : i + 4 * SLOTS] for i in range(0, len(whole), 4 * SLOTS)]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal slots of each pair of rows; texts without shingles are only like each other."""
    empty = (x == 0xFFFF).all(1) != (y == 0xFFFF).all(1)
    return np.where(empty, 0.0, (x == y).mean(1))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``."""
    keep = [c for c in docs.columns if c.lower() != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = K.Permutations(SLOTS)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(hexed(signatures(permutations, batch.column(text))), pa.string())], [*keep, "fingerprint"])

    docs = docs.select(*keep)
    return docs.mapInArrow(run, docs.withColumn("fingerprint", F.lit("")).schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(permutations: K.Permutations, ids: list, texts: list[str], guests: list[bool]) -> pa.RecordBatch:
    """Results of all rows but guests and the last one, which are only next ones."""
    rows = [k for k in range(len(ids) - 1) if not guests[k]]
    edited = []
    for k in rows:
        cut = len(texts[k]) // 4
        edited.append(texts[k][: len(texts[k]) - cut] + texts[k + 1][:cut])
    every = signatures(permutations, pa.array(texts, pa.string()))
    own, after = every[rows], every[[k + 1 for k in rows]]
    new = signatures(permutations, pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[k] for k in rows], pa.int64()),
            pa.array([len(texts[k]) for k in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(hexed(own), pa.string()),
            pa.array(hexed(new), pa.string()),
            pa.array(likeness(own, new), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _dealt(named: DataFrame, per_range: int) -> DataFrame:
    """(part, guest, doc_id, text), each range of ids in one task, ordered, with the next range's smallest row as guest behind it."""
    ranges = max(1, min(RANGES, named.count() // per_range))
    cuts = sorted(set(named.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    infinite = float("inf")
    if cuts:
        numbered = Bucketizer(splits=[-infinite, *cuts, infinite], inputCol="_id", outputCol="part").transform(named.withColumn("_id", F.col("doc_id").cast("double"))).withColumn("part", F.col("part").cast("int")).drop("_id")
    else:
        numbered = named.withColumn("part", F.lit(0))
    least = sorted((r["part"], r["id"]) for r in numbered.groupBy("part").agg(F.min("doc_id").alias("id")).collect())  # a row a range
    hosts = [(least[k][1], least[k - 1][0]) for k in range(len(least))]  # the first range's smallest row is the last one's guest
    hosts = named.sparkSession.createDataFrame(hosts, "doc_id long, host int")
    place = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    places = F.array_compact(F.array(place(F.col("part"), False), F.when(F.col("host").isNotNull(), place(F.col("host"), True))))
    both = numbered.join(F.broadcast(hosts), "doc_id", "left").select("doc_id", "text", F.explode(places).alias("at")).select("at.part", "at.guest", "doc_id", "text")
    return both.repartition(max(1, len(least) // 4), "part").sortWithinPartitions("part", "guest", "doc_id", "text")


def with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", per_range: int = RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = K.Permutations(SLOTS)
        last: tuple | None = None
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part, guest, ids, texts = (batch.column(c).slice(i, ROWS).to_pylist() for c in ("part", "guest", "doc_id", "text"))
                if last:
                    part, guest, ids, texts = ([old, *new] for old, new in zip(last, (part, guest, ids, texts), strict=True))
                edge = [0, *(k for k in range(1, len(part)) if part[k] != part[k - 1]), len(part)]
                for a, b in zip(edge, edge[1:]):
                    yield _walk(permutations, ids[a:b], texts[a:b], guest[a:b])
                last = (part[-1], guest[-1], ids[-1], texts[-1])

    out = _dealt(docs.where("doc_id is not null"), per_range).mapInArrow(run, EDITED)
    nameless = fingerprints(docs.where("doc_id is null"))
    return out.unionByName(nameless.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint"), allowMissingColumns=True)


#: Fingerprints as sketches to be banded: 16 bits of each slot, bands of four.
SIGNATURE = neardup.Scheme(SLOTS, 16, 4, shift=48)


def similar_groups(docs: DataFrame, tables: Tables, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) under links of at least ``percent`` percent Jaccard similarity; see :mod:`neardup` for how buckets of bands are searched."""
    return neardup.groups(docs, tables, SHINGLE, percent, text, doc_id, SIGNATURE)
