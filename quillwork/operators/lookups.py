"""Joining many rows to a keyed lookup table of any size, whatever the key distribution."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.sources.storage import durable

# A lookup up to this many bytes is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
# A lookup whose mean partition has up to this many bytes is met by a hash table.
HASHED_BYTES = 32 * 1024 * 1024
# Pieces a hot key is cut into.
SALTS = 64


def estimated_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size: 8 bytes a cell, the bytes of texts, nested cells as text."""
    per_row = F.lit(8 * len(df.columns) + 16)
    for name, kind in df.dtypes:
        if kind == "string":
            per_row = per_row + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            per_row = per_row + 2 * F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint")).first()[0]


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``rows`` joined to ``lookup`` (``left`` or ``inner``) on equal ``on`` columns.

    A lookup whose measured size fits is broadcast. Otherwise both sides are shuffled, and a key
    holding more than 1/8 of a mean partition of ``rows`` is cut into ``salts`` pieces by the hash
    of the ``spread`` columns while its lookup rows are copied to every piece. At most eight keys
    per shuffle partition can be that frequent, which bounds the list of hot keys. A caller that
    knows how many rows each key has passes them as ``counts``: the ``on`` columns and ``_n``.
    """
    size = estimated_bytes(lookup)
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(lookup), on, how)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = durable(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_n") * 8 * width > F.lit(total)).select(*on, F.lit(salts).alias("_cuts"))
    hot = F.broadcast(hot)
    cuts = F.coalesce(F.col("_cuts"), F.lit(1))
    # a null key meets nothing on the other side, so its rows may go anywhere
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    pieces = F.when(keyless, F.lit(salts)).otherwise(cuts).cast("bigint")
    left = rows.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), pieces).cast("int")
    )
    right = lookup.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), cuts - 1))
    )
    right = right.drop("_cuts")
    # where a partition's share of the lookup is small, a hash table of it saves the sort of all rows
    if size <= width * HASHED_BYTES:
        right = right.hint("shuffle_hash")
    return left.drop("_cuts").join(right, [*on, "_salt"], how).drop("_salt")
