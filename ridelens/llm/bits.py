"""A set of 64-bit hashes as a bitmap of fixed size: a filter that lets all members through, and some others.

Its size does not grow with the set, so it can go to every task. Whatever passes must be checked by an exact step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits of one row of the aggregate
ROW = 1 << 15


def bit_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits (2**15 at least) as bytes: bit (hash modulo 2**bits) is set for every hash. The rows that reach
    the driver are at most 2**bits / 32768, of 4 KB each."""
    bits = max(bits, 15)
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.filter(F.col(column).isNotNull()).select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("row")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(ROW - 1))).alias("set"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in rows.collect():
        out[row["row"] * ROW // 8 : (row["row"] + 1) * ROW // 8] = np.frombuffer(row["set"], dtype=np.uint8)
    return out


def passes(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the uint64 hashes whose bit is set."""
    place = hashes & np.uint64(len(found) * 8 - 1)
    return (found[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0
