"""What several operators share: tables cut out of their lineage, bounded samples, Arrow helpers."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.sources.writers import write_fresh

#: Bytes of the rows that go to a Python worker at once under ``small_batches``.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; ``options`` go to the writer.

    Later steps start from the files, which every executor sees and which outlive any of them.
    """
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_fresh(df, f"llm-{label}", **options))


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Jobs that run inside send rows to Python workers in batches of about ``size`` bytes, one row at least.

    An executor holds a batch outside its heap, twice while it grows, and the worker holds it again.
    """
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_KEY)
        else:
            spark.conf.set(_BATCH_KEY, before)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def bounded_sample(ids: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` distinct non-null keys, the same ones for any partitioning of the input."""
    distinct = ids.where(F.col(key).isNotNull()).select(key).distinct()
    return distinct.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(rows)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of a key's text modulo ``folds``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def slices(batches, rows: int = 512):
    """Record batches of at most ``rows`` rows, so that the Python objects of few rows live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_list(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), type=pa.int64())


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
