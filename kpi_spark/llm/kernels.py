"""Array kernels on text columns: words, word hashes and shingles of many texts at once.

They run inside ``mapInArrow`` tasks.  A batch's UTF-8 buffer is viewed as one
byte array and cut into pieces of about ``PIECE`` bytes (a single longer text is
a piece of its own), so memory follows the piece and not the partition.

Hashes of spans have 64 bits.  Those of up to ``LONG`` bytes are polynomials modulo 2**64, which
tell such short spans apart but for chance; longer ones, for which polynomials of that kind have
collisions by construction, are hashed by BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
PIECE = 1 << 20
#: Bytes of a span up to which the polynomial is its hash.
LONG = 256

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + LONG + 1)
            self.up, self.down = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
        return self.up[:n], self.down


_POWERS = _Powers()


def lower_table(is_word) -> np.ndarray:
    """Byte -> its A-Z lower-cased byte where ``is_word(byte)`` holds after lower-casing, else 0."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        table[b] = low if is_word(low) else 0
    return table


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and everything beyond ASCII.
ALNUM = lower_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Words ``[^\x20\x09-\x0D]+``: whatever white space separates.  Byte 0 is a word byte, written as that of "A", which lower-casing leaves unused.
NONSPACE = lower_table(lambda b: b != 32 and not 9 <= b <= 13)
NONSPACE[0] = 65


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of a byte array; the spans are ordered and apart, and about ``PIECE`` bytes are worked on at once."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(starts, base + PIECE))
        short = i + np.flatnonzero(ends[i:j] - starts[i:j] <= LONG)
        part = values[base : base + PIECE + LONG]
        up, down = _POWERS.of(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=U)
        np.cumsum((part.astype(U) + U(1)) * up[: len(part)], dtype=U, out=prefix[1:])
        a, b = starts[short] - base, ends[short] - base
        out[short] = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(U) * U(_Q))
        i = j
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = int.from_bytes(blake2b(values[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of each word, and the bytes as the table maps them."""
    low = table[buf]
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = low != 0
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside[:-1]
    edges = off[:-1][np.diff(off) > 0]
    edges = edges[edges > 0]
    glued = edges[inside[edges] & before[edges]]  # words that touch across two rows
    change = inside != before
    starts = np.flatnonzero(change & inside)
    ends = np.flatnonzero(change & before)
    if len(glued):
        starts = np.sort(np.concatenate((starts, glued)))
        ends = np.sort(np.concatenate((ends, glued)))
    return starts, ends, np.searchsorted(off, starts, "right") - 1, low


def word_hashes(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the first word of each row (one more entry than rows)."""
    starts, ends, rows, low = word_spans(buf, off, table)
    return span_hash(low, starts, ends), np.searchsorted(rows, np.arange(len(off)), "left")


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, repeats included, and where each row's begin.

    A row of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    n = len(words)
    count = np.diff(first)
    own = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(first), dtype=np.int64)
    np.cumsum(own, out=begin[1:])
    rolled = words.copy() if n else words
    for j in range(1, k):
        rolled = rolled[: max(0, n - j)] * U(_Q) + words[j:]
    long = np.flatnonzero(count >= k)
    out = np.empty(begin[-1], dtype=U)
    # source position of each shingle: its row's first word plus its rank in the row
    rows = np.repeat(np.arange(len(count)), own)
    at = np.arange(begin[-1]) - begin[rows] + first[rows]
    full = count[rows] >= k
    if len(long):
        out[full] = mix(rolled[at[full]] + U(k))
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = U(0)
        for w in words[first[r] : first[r + 1]].tolist():
            h = (int(h) * _Q + w) & _MASK
        out[begin[r]] = mix(np.array([h], dtype=U) + U(1000 + count[r]))[0]
    return out, begin


class Permutations:
    """``n`` universal hash permutations ``a * x + b`` modulo 2**64, a odd, fixed by the seed."""

    def __init__(self, n: int, seed: int = 1) -> None:
        i = np.arange(1, n + 1, dtype=U)
        self.a = mix(i * U(_P) + U(seed)) | U(1)
        self.b = mix(i * U(_Q) + U(seed + 77))

    def minima(self, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Smallest image of each row's values under each permutation; rows x n; rows without values all ones."""
        rows = len(begin) - 1
        out = np.full((len(self.a), rows), _MASK, dtype=U)
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            at = begin[some]
            image = np.empty(len(values), dtype=U)
            for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                np.multiply(values, a, out=image)
                np.add(image, b, out=image)
                out[i, some] = np.minimum.reduceat(image, at)
        return out.T
