"""Readers for the input tables and for the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the input folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines; without a schema the types are inferred in an extra pass over the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_csv(spark: SparkSession, path: str, schema=None, sep: str = ",") -> DataFrame:
    """CSV with a header line; blanks before a cell do not turn an integer column into doubles."""
    reader = spark.read.options(header=True, sep=sep, ignoreLeadingWhiteSpace=True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_delimited(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """Headerless delimited text whose columns arrive as ``_c0, _c1, ...`` and are renamed.

    Quoting is off: a cell that begins with a quote sign keeps it.
    """
    return spark.read.options(sep=sep, quote="", header=False).csv(path).toDF(*names)


def read_libsvm(spark: SparkSession, path: str, features: int) -> DataFrame:
    """Sparse ``label index:value ...`` text; a declared width saves the pass that finds it."""
    return spark.read.format("libsvm").option("numFeatures", str(features)).load(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core for heavy work per row when the input has fewer splits than there are cores.

    Large inputs have more splits than cores and are left as they are, so nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
