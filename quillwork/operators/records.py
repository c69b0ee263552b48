"""Choosing records by kind, position or name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Record kinds of a page file, with their tags.
KINDS = {"pages": 0, "outlines": 1, "paragraphs": 2}


def split_by_kind(df: DataFrame, tag: str, wanted: str) -> tuple[DataFrame, DataFrame]:
    """The records of the wanted kind, and all others."""
    right = F.coalesce(F.col(tag) == KINDS[wanted], F.lit(False))
    return df.where(right), df.where(~right)


def require_kind(df: DataFrame, tag: str, wanted: str) -> DataFrame:
    """The records unchanged; the job fails at the first one of another kind."""
    message = F.concat(F.lit(f"expected record kind {KINDS[wanted]}, found "), F.col(tag).cast("string"))
    checked = F.when(F.col(tag) == KINDS[wanted], F.col(tag)).otherwise(F.raise_error(message).cast("int"))
    return df.withColumn(tag, checked)


def nth_record(df: DataFrame, key: str, n: int) -> DataFrame:
    """The record at position ``n`` (from 0) in key order; past the end, the last one.

    Only keys are sorted, and only the first ``n + 1`` of them are kept by each task.
    """
    first = df.select(key).orderBy(key).limit(n + 1)
    return df.join(F.broadcast(first.agg(F.max(key).alias(key))), key)
