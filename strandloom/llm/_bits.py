"""A bitmap of fixed size over hashed keys: it leaves out keys that have no row in a table, and loses none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27


def bitmap(keys: DataFrame, width: int = 64) -> np.ndarray:
    """2^BITS bits in bytes: the leading bits of a table's keys, which are hashes of ``width`` bits."""
    at = F.shiftrightunsigned("key", width - BITS) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows.toLocalIterator():  # 2^BITS bits in all
        out[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def marked(bits: np.ndarray, keys: np.ndarray, width: int = 64) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(width - BITS)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0
