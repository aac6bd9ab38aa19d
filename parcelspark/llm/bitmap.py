"""A bitmap of hashes, of one size whatever the table's: rules rows out before a join, which itself stays exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS_LOG2 = 17  # 64-bit slots: 1 MB


def hash_bits(rows: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the top bits of a bigint column of hashes; at most 2**SLOTS_LOG2 rows reach the driver."""
    slot = F.shiftrightunsigned(column, 64 - SLOTS_LOG2)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {58 - SLOTS_LOG2}) & 63 as int))")
    slots = np.zeros(1 << SLOTS_LOG2, dtype=np.int64)
    for r in rows.where(F.col(column).isNotNull()).groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).collect():
        slots[r.slot] = r.bits
    return slots.view(np.uint64)


def may_have(slots: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may be in the bitmap; never false for one that is."""
    place = (hashes >> np.uint64(58 - SLOTS_LOG2)) & np.uint64(63)
    return ((slots[hashes >> np.uint64(64 - SLOTS_LOG2)] >> place) & np.uint64(1)).astype(bool)
