"""Bitmaps of a fixed size that say which values may be in a column, whatever the column's length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits; two megabytes.
BITS = 24


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Set the bit of each value's lowest BITS bits. At most 2 ** (BITS - 6) numbers reach the driver.

    A value that is set is always found; one that is not may be, the more often the fuller the bitmap.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint"))
    words = (
        values.select(place.alias("p"))
        .select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63L as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    found = words.toPandas()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def contains(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.uint64) & np.uint64((1 << BITS) - 1)
    return ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
