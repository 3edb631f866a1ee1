"""Blocked Bloom filters: built by Spark, of bounded size, tested with numpy or with SQL.

A key falls in one 64-bit block (its hash's upper part) and sets three bits there.
Blocks are filled by a grouped ``bit_or``, so the build is one small shuffle; the
finished filter has at most ``MOST`` blocks (8 MB) whatever the number of keys.
Keys beyond what that many blocks can tell apart only raise the share of false
positives, which an exact join after the filter takes out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a filter at most.
MOST = 1 << 20
#: Keys for which a block is meant.
KEYS = 4


def blocks_for(keys: int, most: int = MOST) -> int:
    """A power of two."""
    return min(most, 1 << max(6, (max(1, keys) // KEYS).bit_length()))


def _mask(hashed: Column) -> Column:
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def _block(hashed: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(hashed, 24).bitwiseAND(F.lit(blocks - 1)).cast("int")


def build(keys: Column, df: DataFrame, most: int = MOST, hashed: bool = False) -> np.ndarray:
    """The filter's blocks (int64) over the non-null values of ``keys`` in ``df``; hashed: they are 64-bit hashes themselves."""
    hashed = df.where(keys.isNotNull()).select((keys if hashed else F.xxhash64(keys)).alias("h"))
    blocks = blocks_for(hashed.count(), most)
    filled = hashed.groupBy(_block(F.col("h"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("h"))).alias("bits"))
    out = np.zeros(blocks, dtype=np.int64)
    got = filled.toPandas()  # at most one row a block
    out[got["block"].to_numpy()] = got["bits"].to_numpy()
    return out


def maybe(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each key (by its hash) may be in the filter."""
    h = hashes.view(np.uint64)
    one, low = np.uint64(1), np.uint64(63)
    mask = (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low))
    block = filter_.view(np.uint64)[((h >> np.uint64(24)) & np.uint64(len(filter_) - 1)).astype(np.int64)]
    return (block & mask) == mask
