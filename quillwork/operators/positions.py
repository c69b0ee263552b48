"""Row positions and ranks over a whole table, without a single-task window."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.sources.storage import durable

# monotonically_increasing_id() keeps the partition number above this bit
_ROW_BITS = 33


def _ordered_parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` range-partitioned and sorted on disk, with its part number and row number in the part."""
    stored = durable(df.orderBy(*order))
    return stored.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def _part_sizes(parts: DataFrame, measure: Column) -> list[int]:
    """``measure`` of every part in order: one number per part reaches the driver."""
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(measure.alias("n")).collect()}
    return [sizes.get(part, 0) for part in range(max(sizes, default=0) + 1)]


def _before(sizes: list[int]) -> Column:
    """What lies before the part of a row, looked up in an array constant."""
    starts = [0, *accumulate(sizes)][: len(sizes)]
    return F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_part"))


def with_position(
    df: DataFrame, order: list[Column | str], name: str = "idx", start: int = 0
) -> DataFrame:
    """Add each row's position in the whole-table order.

    ``order`` must be total; then the result does not depend on how the rows are partitioned. The
    sort is a distributed range sort, so no task sees more than its own range.
    """
    parts = _ordered_parts(df, order)
    position = _before(_part_sizes(parts, F.count(F.lit(1)))) + F.col("_row") + start
    return parts.select(*df.columns, position.alias(name))


def rows_at_ranks(df: DataFrame, order: list[Column | str], weight: str, ranks: list[int]) -> DataFrame:
    """The rows that cover given ranks when every row stands for ``weight`` equal rows.

    Adds ``rank``. The totals of the sorted parts tell which parts hold a wanted rank; only those
    are summed up row by row.
    """
    parts = _ordered_parts(df, order)
    sizes = _part_sizes(parts, F.sum(weight))
    ends = list(accumulate(sizes))
    wanted = sorted({r for r in ranks if 0 <= r < (ends[-1] if ends else 0)})
    holding = sorted({bisect_right(ends, r) for r in wanted})
    within = F.sum(weight).over(
        Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = parts.where(F.col("_part").isin(holding)).withColumn("_upto", _before(sizes) + within)
    covered = F.filter(
        F.array(*[F.lit(r).cast("bigint") for r in wanted]).cast("array<bigint>"),
        lambda r: (r >= F.col("_upto") - F.col(weight)) & (r < F.col("_upto")),
    )
    return summed.select(*df.columns, F.explode(covered).alias("rank"))
