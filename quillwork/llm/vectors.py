"""Vectors out of an array column, as matrices of rows of one length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def raw(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
