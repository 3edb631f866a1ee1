"""Best-fit packing of documents into sequences, certified by lower bounds.

:func:`pieces` encodes each document, ends it with an end id and cuts only what is longer
than a sequence; :func:`pack` puts the pieces into as few sequences as it can.

1. Pieces as long as a sequence are sequences of their own.  The others are dealt to
   partitions of about ``PART`` pieces by a hash of their row's number, so neither copies nor a hot
   source gather, and each partition is packed by best-fit decreasing.  Pieces of one length
   are placed together, so the time of a partition follows its different lengths.
2. Dual-feasible functions (the threshold, the rounding and the stepwise family of
   Fekete and Schepers, each with all its parameters) give a lower bound of a partition's
   number of sequences from its counts of lengths.  A partition that meets its bound is certified.
3. Partitions with a gap hand over the pieces of all sequences that aren't full, certified ones those
   of sequences with more than ``SLACK`` of their room free and of their emptiest one (what one partition
   has too much of, another may lack).  These are dealt anew and packed again.  A new packing counts if it is shorter than what was handed over; else the old one
   stays and the rounds end.  They also end with a single partition, or when the bound
   of all pieces together is met, at the latest after ``ROUNDS``.

Each round reads a written table of narrow rows (no texts, no ids), so a lost executor costs a task.

Defined results: a null or empty text has only its end id; rows that repeat an id or a text are
packed each; a null id stays null; strings of special tokens are ordinary text; an empty table gives
no rows; columns other than the id and the text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpi_spark.llm import bpe
from kpi_spark.llm import kernels as K
from kpi_spark.llm.store import Tables

#: Ids of a sequence, the id behind each document, pieces of a partition, rounds at most, and the share of a certified sequence that may stay free.
CAPACITY, END, PART, ROUNDS, SLACK = 2048, 0, 200_000, 6, 1 / 16
#: Largest parameter of the rounding family.
STEPS = 100

#: Bytes of a pre-token up to which the library merges it (its time grows with the square), longer ones go through the rank queue.
SHORT = 256
_ENCODERS: dict[int, bpe.Encoder] = {}

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder(bpe.Encoder):
    """The batch encoder, whose new pre-tokens are merged by a library."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__(ranks)
        self.library = tiktoken.Encoding("pre-tokens", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.library._encode_single_piece(piece) if len(piece) <= SHORT else super().encode_piece(piece)


def _encoder(key: int, rank_lines: str) -> _Encoder:
    """One per Python worker and vocabulary, so that its cache outlives a task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _Encoder(bpe.load_ranks(rank_lines))
    return _ENCODERS[key]


def _cut(ids: np.ndarray, begin: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(row, piece, start, length, crc32) of the pieces of rows whose ids stand one behind the other."""
    size = np.diff(begin)
    n = -(-size // capacity)
    rows = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    first = (size - capacity * (n - 1))[rows]  # only the first piece may be shorter
    start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
    length = np.where(piece > 0, capacity, first)
    data, at = memoryview(ids.astype("<u4").tobytes()), begin[rows] + start
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
    return rows, piece, start, length, np.array(crc, dtype=np.int64)


def pieces(docs: DataFrame, rank_lines: str, capacity: int = CAPACITY, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a piece (``PIECES``); ``row`` numbers them within this run of the plan, so write the table before it is read twice.

    rank_lines: the text of a rank file (of fixed size, some hundred KB, broadcast).
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_lines)
    key = hash(rank_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            buf, off = K.text_buffer(batch.column(1))
            for i, j in K.pieces(off, bpe.PIECE):
                ids, begin = bpe.encode_rows(encoder, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                ended = np.insert(ids, begin[1:], end)
                rows, piece, start, length, crc = _cut(ended, begin + np.arange(len(begin)), capacity)
                own = batch.column(0).slice(i, j - i).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(rows))), own, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])
                row += len(rows)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Fewest sequences that pieces can take, of which ``counts[x]`` have length x; the capacity is the last index."""
    c = len(counts) - 1
    x, counts = np.arange(c + 1), counts.astype(np.int64)
    below, total = np.cumsum(counts), np.cumsum(counts * x)  # up to and including each length
    # threshold t: lengths over c - t count as c, those under t as nothing
    t = np.arange(c // 2 + 1)
    middle = total[c - t] - np.where(t > 0, total[t - 1], 0)
    best = int((below[c] - below[c - t] - (-middle // c)).max())
    # rounding k: multiples of c / (k + 1) stay, others are rounded down to multiples of it and scaled by (k + 1) / k
    k = np.arange(1, STEPS + 1)[:, None]
    rounded = np.where((k + 1) * x % c == 0, k * x, (k + 1) * x // c * c) @ counts
    best = max(best, int((-(-rounded // (k[:, 0] * c))).max()))
    # step e: lengths from e up to half the capacity count as one of c // e, longer ones as what their complement leaves
    e = np.arange(1, c // 2 + 1)[:, None]
    stepped = np.where(2 * x > c, c // e - (c - x) // e, x >= e) @ counts
    return max(best, int((-(-stepped // (c // e[:, 0]))).max(initial=0)))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the sequence and offset of each piece, and what stays free in each sequence."""
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    own = np.empty(len(lengths), dtype=np.int64)
    free = np.empty(len(lengths), dtype=np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    rooms = n = 0  # rooms: bit r is set if sequences with r free places wait

    def put(room: int, some: np.ndarray) -> None:
        nonlocal rooms
        free[some] = room
        if room and len(some):
            waiting.setdefault(room, []).append(some)
            rooms |= 1 << room

    edges = np.append(np.flatnonzero(np.diff(ordered, prepend=-1)), len(ordered))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        size = int(ordered[a])
        while a < b:
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                some = np.concatenate(waiting.pop(room))
                rooms &= ~(1 << room)
            else:
                room = capacity
                some = np.arange(n, n - (-(b - a) // (room // size)))
                n += len(some)
            each = room // size
            whole = min(len(some), (b - a) // each)
            own[order[a : a + whole * each]] = np.repeat(some[:whole], each)
            put(room - each * size, some[:whole])
            a, some = a + whole * each, some[whole:]
            if len(some) and a < b:
                own[order[a:b]] = some[0]
                put(room - (b - a) * size, some[:1])
                a, some = b, some[1:]
            put(room, some)
    within = np.lexsort((np.arange(len(order)), own[order]))
    placed = order[within]
    before = np.cumsum(lengths[placed]) - lengths[placed]
    head = np.flatnonzero(np.diff(own[placed], prepend=-1))
    offset = np.empty(len(lengths), dtype=np.int64)
    offset[placed] = before - np.repeat(before[head], np.diff(np.append(head, len(placed))))
    return own, offset, free[:n]


def _counts(loose: DataFrame, capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, dtype=np.int64)
    for r in loose.groupBy("length").count().collect():  # a row a length, so no more than the capacity
        out[r["length"]] = r["count"]
    return out


def _packed(pool: DataFrame, n: int, number: int, capacity: int, part: int) -> tuple[DataFrame, int]:
    """``pool`` packed by partitions: sequence_id, offset, certified, ``given`` (whether its piece is handed over), ``lone`` (first of its sequence)."""
    parts = -(-n // part)
    pool = pool.select(*(f.split()[0] for f in PIECES.split(", ")))
    schema = f"{PIECES}, sequence_id long, offset long, certified boolean, given boolean, lone boolean"

    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        own, offset, free = best_fit(lengths, capacity)
        certified = len(free) == lower_bound(np.bincount(lengths, minlength=capacity + 1))
        given = (free > SLACK * capacity) | (np.arange(len(free)) == np.argmax(free)) if certified else free > 0
        base = number << 56 | table["part"][0].as_py() << 28
        more = [pa.array(base + own), pa.array(offset), pa.array(np.full(len(own), certified)), pa.array(given[own]), pa.array(offset == 0)]
        return pa.table(table.drop_columns("part").columns + more, names=[f.split()[0] for f in schema.split(", ")])

    dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(number), "row"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(run, schema), parts


def pack(pieces_: DataFrame, tables: Tables, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """``pieces_`` (a written table) with sequence_id, offset and ``certified``: whether the partition that packed it met its bound."""
    final = pieces_.where(F.col("length") >= capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    pool = pieces_.where(F.col("length") < capacity)
    counts = _counts(pool, capacity)
    n, goal, settled, old = int(counts.sum()), lower_bound(counts), 0, None
    for number in range(1, rounds + 1) if n else ():
        out, parts = _packed(pool, n, number, capacity, part)
        out = tables.put(out, f"packed-{number}")
        sums = out.agg(*(F.coalesce(F.count_if(c), F.lit(0)).alias(name) for name, c in (("bins", F.col("lone")), ("pieces", F.col("given")), ("handed", F.col("given") & F.col("lone"))))).first()
        if old is not None and sums["bins"] >= old[1]:
            final = final.unionByName(old[0])  # no gain: what was handed over stays as it was
            break
        if parts == 1 or number == rounds or sums["handed"] < 2 or settled + sums["bins"] == goal:
            final = final.unionByName(out.drop("given", "lone"))
            break
        final = final.unionByName(out.where("not given").drop("given", "lone"))
        settled += sums["bins"] - sums["handed"]
        pool, n = out.where("given"), sums["pieces"]
        old = (pool.drop("given", "lone"), sums["handed"])
    return final


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequences, bound): how many there are, and the fewest that the same pieces can take."""
    n = packed.where("offset = 0").count()
    return packed.sparkSession.createDataFrame([(n, lower_bound(_counts(packed, capacity)))], "sequences long, bound long")
