r"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

:func:`encode` adds an ``ids`` column (array of int) to a DataFrame, :func:`decode`
turns such a column back into bytes, :func:`round_trip` does both in one pass.  All are
per-row: no shuffle, whole texts.

Each pre-token becomes a linked list of byte positions.  Adjacent pairs wait in
buckets, one per merge rank; a two-level bitmap over the ranks finds the lowest
rank in use by find-first-set; entries whose pair has changed meanwhile are stale
and skipped.  A pre-token of n bytes so costs about n log n, however long it is.

Pre-tokens are cut for many texts at once with numpy by the rules of the split
pattern (contractions; letters, numbers or other symbols with at most one space
before; white space).  Encoded pre-tokens are kept with their bytes in a cache of at most
``CACHE`` entries per Python worker, found by hashes and used only where the bytes are equal.

Defined results: null and empty texts give an empty id list; a null id list decodes
to empty bytes; repeated rows are each encoded; other columns pass through, and an
existing ``ids`` (``decoded``) column is replaced.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kpi_spark.llm import kernels as K

#: Pre-tokens whose ids one Python worker remembers, and bytes of text worked on at once.
CACHE, PIECE = 300_000, 1 << 19

# fixed values: the split pattern's contractions and Unicode's White_Space characters
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def load_ranks(lines: str) -> dict[bytes, int]:
    """Token bytes -> rank, from the text of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}


class RankQueue:
    """Buckets of positions by rank, under a bitmap of two levels of 256-bit words, in which find-first-set finds the lowest rank in use."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}

    def fill(self, pairs: list[int]) -> int:
        """Puts in the ranks of all positions (-1: none); returns the upper level, an int with a bit for each word in use."""
        low, buckets, top = self.low, self.buckets, 0
        for i, rank in enumerate(pairs):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        return top


class Encoder:
    """Encodes pre-tokens by a rank table and remembers up to ``cache`` of them, bytes and ids, in a few arrays."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE) -> None:
        self.ranks, self.longest, self.limit = ranks, max(map(len, ranks)), cache
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.keys = np.zeros(0, np.uint64)  # ascending hashes; entry k's ids are ids.of(k), its bytes raw.of(k)
        self.ids, self.raw = _Lists(np.int32), _Lists(np.uint8)
        self.used, self.clock = np.zeros(0, np.int32), 0

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, low, buckets, longest = len(piece), self.queue.low, self.queue.buckets, self.longest
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair += (-1, -1)
        top = self.queue.fill(pair)
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            bit = word & -word
            rank = (high << 8) + bit.bit_length() - 1
            bucket = buckets[rank]
            i = bucket[0]
            if len(bucket) > 1:
                heappop(bucket)
            else:
                del buckets[rank]
                word ^= bit
                low[high] = word
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            after[i] = end
            pair[gone] = pair[i] = -1
            left = before[i]
            if end < n:
                before[end] = i
                stop = after[end]
                if stop - i <= longest:
                    r = get(piece[i:stop], -1)
                    if r >= 0:
                        pair[i] = r
                        if r in buckets:
                            heappush(buckets[r], i)
                        else:
                            buckets[r] = [i]
                            low[r >> 8] |= 1 << (r & 255)
                            top |= 1 << (r >> 8)
            if left >= 0:
                r = get(piece[left:end], -1) if end - left <= longest else -1
                pair[left] = r
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], left)
                    else:
                        buckets[r] = [left]
                        low[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(get(piece[i:j]))
            i = j
        return out

    def remembered(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of pre-tokens (spans of ``buf``, ascending distinct hashes); -1 where other bytes have the entry of that hash."""
        self.clock += 1
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == hashes[inner]
        self.used[at[known]] = self.clock
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > self.limit or len(self.ids.flat) + len(self.raw.flat) > 24 * self.limit:
                self._forget()
            whole = buf.tobytes()
            ids = [self.encode_piece(whole[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            order = np.argsort(keys := np.concatenate((self.keys, hashes[new])), kind="stable")
            self.keys = keys[order]
            self.used = np.concatenate((self.used, np.full(len(new), self.clock, np.int32)))[order]
            size = np.array([len(x) for x in ids], np.int64)
            self.ids.add(np.fromiter(chain.from_iterable(ids), np.int32), size, order)
            n = ends[new] - starts[new]
            self.raw.add(buf[_spread(starts[new], n)], n, order)
            at = np.searchsorted(self.keys, hashes)
        old = np.flatnonzero(known)
        same = _equal(self.raw.flat, self.raw.begin[at[old]], self.raw.size[at[old]], buf, starts[old], ends[old] - starts[old])
        at[old[~same]] = -1
        return at

    def _forget(self) -> None:
        """Keeps what the current texts use and at most half of the limit of what was used last."""
        recent = np.sort(self.used)[-min(len(self.used), self.limit // 2) :][0] if len(self.used) else 0
        kept = np.flatnonzero((self.used == self.clock) | (self.used > recent))
        self.keys, self.used = self.keys[kept], self.used[kept]
        self.ids.keep(kept)
        self.raw.keep(kept)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of spans, one after another."""
    size = size.astype(np.int64)
    before = np.cumsum(size) - size
    out = np.repeat(begin - before, size)
    out += np.arange(len(out))
    return out


def _equal(x: np.ndarray, x_begin: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_begin: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether the spans of two byte arrays are equal, pair by pair."""
    same = x_size == y_size
    n = np.where(same, x_size, 0)
    bad = np.flatnonzero(x[_spread(x_begin, n)] != y[_spread(y_begin, n)])
    same[np.searchsorted(np.cumsum(n), bad, "right")] = False
    return same


class _Lists:
    """Lists of numbers in one flat array."""

    def __init__(self, kind: type) -> None:
        self.flat, self.begin, self.size = np.zeros(0, kind), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> None:
        """More lists, and the order of all of them."""
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, flat))
        self.begin = np.concatenate((self.begin, begin.astype(np.int32)))[order]
        self.size = np.concatenate((self.size, size.astype(np.int32)))[order]

    def keep(self, some: np.ndarray) -> None:
        begin, size = self.begin[some], self.size[some]
        self.flat, self.begin, self.size = self.flat[_spread(begin, size)], (np.cumsum(size) - size).astype(np.int32), size


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    if not _CLASSES:
        kind = {"L": _LETTER, "N": _NUMBER}
        table = np.array([kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], dtype=np.uint8)
        table[list(WHITE_SPACE)] = _SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def split_starts(chars: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start.  chars: code points of the texts, one after another; off: where each text begins, and the end."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[chars]
    head = np.zeros(n + 1, dtype=bool)
    head[off] = True
    space = kind == _SPACE
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = chars[:-1] == 32
    blank_before[head[:n]] = False
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start[head[:n]] = True
    more = ~head[1:]  # the text goes on after this character
    solid_next = np.zeros(n, dtype=bool)
    solid_next[:-1] = ~space[1:]
    start |= space & more & solid_next  # the last white space before something else stands alone
    start &= space | ~blank_before  # or joins it, if it is a blank
    for p in np.flatnonzero(start & (chars == 39) & more).tolist():
        if kind[p + 1] != _LETTER:
            continue
        tail = chr(chars[p + 1]) + (chr(chars[p + 2]) if p + 2 < n and not head[p + 2] else "")
        size = next((len(c) for c in CONTRACTIONS if tail.startswith(c)), 0)
        if size:
            start[p + 1] = False
            if p + 1 + size < n:
                if kind[p + 1 + size] == _LETTER:
                    start[p + 1 + size] = True
    return np.flatnonzero(start)


def encode_rows(encoder: Encoder, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a buffer, and where each text's ids begin."""
    whole = buf.tobytes()
    lead = (buf & 0xC0) != 0x80
    if lead.all():
        chars, char_off, byte_at = buf, off, None
    else:
        chars = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero(lead), len(buf))
        char_off = np.searchsorted(byte_at, off)
    at = split_starts(chars, char_off)
    starts = at if byte_at is None else byte_at[at]
    ends = np.append(starts[1:], len(buf))
    hashes = K.span_hash(buf, starts, ends)
    unique, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    entry = encoder.remembered(unique, buf, starts[one], ends[one])[which]
    same = _equal(buf, starts, ends - starts, buf, starts[one][which], (ends - starts)[one][which])
    entry[~same] = -1
    n = np.where(entry >= 0, encoder.ids.size[entry], 0)
    extra = {i: encoder.encode_piece(whole[starts[i] : ends[i]]) for i in np.flatnonzero(entry < 0).tolist()}  # other bytes under a hash in use
    for i, x in extra.items():
        n[i] = len(x)
    total = np.concatenate(([0], np.cumsum(n)))
    begin = np.where(entry >= 0, encoder.ids.begin[entry], 0)
    ids = np.empty(total[-1], np.int32)
    known = np.flatnonzero(entry >= 0)
    ids[_spread(total[known], n[known])] = encoder.ids.flat[_spread(begin[known], n[known])]
    for i, x in extra.items():
        ids[total[i] : total[i + 1]] = x
    return ids, total[np.searchsorted(starts, off)]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(key: int, ranks: dict[bytes, int]) -> Encoder:
    """One per Python worker and vocabulary, so that its cache outlives a task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def _replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name.lower() != name] + [T.StructField(name, kind)])


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns of batches and the ids of their texts."""
    for batch in batches:
        buf, off = K.text_buffer(batch.column(text))
        for i, j in K.pieces(off, PIECE):
            ids, begin = encode_rows(encoder, buf[off[i] : off[j]], off[i : j + 1] - off[i])
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [lists], [*keep, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], ids: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns of batches and the bytes of their id lists."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    base = np.cumsum(size) - size
    for batch in batches:
        column = batch.column(ids)
        for i in range(0, len(column), 256):
            part = column.slice(i, 256)
            count = np.array(part.value_lengths().fill_null(0), dtype=np.int64)
            own = np.asarray(part.flatten(), dtype=np.int64)
            n = size[own]
            total = np.concatenate(([0], np.cumsum(n)))
            data = flat[np.arange(total[-1]) - np.repeat(total[:-1] - base[own], n)]
            begin = total[np.concatenate(([0], np.cumsum(count)))]
            out = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)])
            rows = batch.slice(i, 256)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [out], [*keep, "decoded"])


def _others(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in names]


def encode(df: DataFrame, rank_lines: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``ids``, the token ids of its text column.

    rank_lines: the text of a rank file (its size is fixed, some hundred KB, and it is broadcast).
    keep_text: whether the text column stays.
    """
    shared, key = df.sparkSession.sparkContext.broadcast(rank_lines), hash(rank_lines)
    given = _others(df, "ids")
    keep = [c for c in given if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, _ENCODERS.get(key) or _encoder(key, load_ranks(shared.value)), text, keep)
        pa.default_memory_pool().release_unused()  # the worker outlives the task

    return df.select(*given).mapInArrow(run, _replaced(df.select(*keep).schema, "ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, rank_lines: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes that its id lists stand for."""
    shared = df.sparkSession.sparkContext.broadcast(rank_lines)
    keep = _others(df, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(batches, load_ranks(shared.value), ids, keep)
        pa.default_memory_pool().release_unused()

    return df.select(*keep).mapInArrow(run, _replaced(df.schema, "decoded", T.BinaryType()))


def round_trip(df: DataFrame, rank_lines: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``ids`` as by :func:`encode` and ``decoded`` as by :func:`decode`, in one Python worker a task."""
    shared, key = df.sparkSession.sparkContext.broadcast(rank_lines), hash(rank_lines)
    given = _others(df, "ids", "decoded")
    keep = [c for c in given if keep_text or c != text]
    encoded = _replaced(df.select(*keep).schema, "ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(key) or _encoder(key, load_ranks(shared.value))
        yield from _decoded(_encoded(batches, encoder, text, keep), encoder.ranks, "ids", [*keep, "ids"])
        pa.default_memory_pool().release_unused()

    return df.select(*given).mapInArrow(run, _replaced(encoded, "decoded", T.BinaryType()))
