"""Recoding, rescaling and banding of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recode(df: DataFrame, column: str, names: dict, out: str, default: str | None = None) -> DataFrame:
    """Replace codes by their names from a fixed mapping; other codes and nulls get ``default``.

    The mapping is program text, so it is small by construction and its table can be broadcast.
    """
    code_type = df.schema[column].dataType.simpleString()
    mapping = df.sparkSession.createDataFrame(
        list(names.items()), schema=f"{column} {code_type}, {out} string"
    )
    joined = df.join(F.broadcast(mapping), column, "left")
    return joined.select(*df.columns, F.coalesce(F.col(out), F.lit(default)).alias(out))


def statistics(df: DataFrame, **measures: Column) -> Column:
    """Whole-table aggregates as the fields of one scalar subquery, usable in any expression."""
    return df.agg(F.struct(*[m.alias(n) for n, m in measures.items()])).scalar()


def affine_rescale(df: DataFrame, column: str, out: str, new_mean: float) -> DataFrame:
    """Standardise, then stretch by (old mean / 4.1) and shift to ``new_mean``."""
    s = statistics(df, mean=F.avg(column), std=F.stddev_samp(column))
    standard = F.try_divide(F.col(column) - s["mean"], s["std"])
    return df.withColumn(out, standard * (s["mean"] / F.lit(4.1)) + F.lit(new_mean))


def minmax_rescale(
    df: DataFrame, column: str, out: str, span: tuple[float, float], digits: int
) -> DataFrame:
    """Map the column's own range onto ``span`` and round."""
    low, high = span
    s = statistics(df, low=F.min(column), high=F.max(column))
    share = F.try_divide(F.col(column) - s["low"], s["high"] - s["low"])
    return df.withColumn(out, F.round(share * (high - low) + low, digits))


def banded(
    value: Column, relaxed: Column, limits: list[tuple[float, str]], above: str, slack: float
) -> Column:
    """The name of the first band whose limit covers ``value``; ``relaxed`` rows get ``slack`` more."""
    extra = F.when(relaxed, F.lit(slack)).otherwise(F.lit(0))
    bands = None
    for limit, name in limits:
        hit = value <= F.lit(limit) + extra
        bands = F.when(hit, name) if bands is None else bands.when(hit, name)
    return bands.otherwise(above)
