"""Numeric feature preparation, splits and class balance."""

from __future__ import annotations

from pyspark.ml.feature import (
    Normalizer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorIndexer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.positions import with_position


def string_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """Most frequent value 0.0, then 1.0, ...; equally frequent values in alphabetical order."""
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="frequencyDesc").fit(df).transform(df)


def one_hot(df: DataFrame, index: str, out: str) -> DataFrame:
    """Indicator vector; the last level is all zeros."""
    return OneHotEncoder(inputCol=index, outputCol=out).fit(df).transform(df)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """One vector from numeric and vector columns; a null or NaN cell is an error, not a lost row."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def vector_index(df: DataFrame, column: str, out: str, max_categories: int) -> DataFrame:
    """Recode the vector slots that hold few distinct values as category numbers."""
    return VectorIndexer(inputCol=column, outputCol=out, maxCategories=max_categories).fit(df).transform(df)


def unit_deviation(df: DataFrame, column: str, out: str) -> DataFrame:
    """Every slot divided by its sample standard deviation, not centred."""
    return StandardScaler(inputCol=column, outputCol=out, withStd=True, withMean=False).fit(df).transform(df)


def unit_length(df: DataFrame, column: str, out: str) -> DataFrame:
    return Normalizer(inputCol=column, outputCol=out, p=2.0).transform(df)


def hash_share(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends only on the key and the seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def stable_split(df: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that cover the table; a row's part does not depend on partitioning."""
    first = hash_share(F.col(key), seed) < share
    return df.where(first), df.where(~first)


def rebalance(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """All negatives and exactly ``round(positives * 4 * share)`` positives, drawn without replacement.

    The draw is the start of the hash order of the keys, so it is the same on every run.
    """
    ratio = share * (2 / 0.5)
    if not 0 <= ratio <= 1:
        raise ValueError(f"share {share} asks for {ratio} times the positives")
    positives, negatives = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    wanted = round(positives.count() * ratio)
    drawn = with_position(positives.withColumn("_h", hash_share(F.col(key), seed)), ["_h", key], "_i")
    return drawn.where(F.col("_i") < wanted).select(*df.columns).unionByName(negatives)
