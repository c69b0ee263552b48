"""Records kept by name, so that a lookup reads only the files and row groups that may hold the names asked for."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillwork.operators.lookups import lookup_join
from quillwork.sources.storage import fresh_path
from quillwork.sources.writers import write_fresh

#: Bytes of a row group; a lookup reads whole row groups.
GROUP_BYTES = 4 * 1024 * 1024
#: Up to so many different names become conditions of the scan.
SCAN_NAMES = 64


@dataclass
class NameIndex:
    """``path`` holds the records in order of name, ``files`` the first and last name of each file (file, low, high)."""

    spark: SparkSession
    path: str
    name: str
    schema: StructType
    files: DataFrame

    def matching_files(self, asked: DataFrame) -> list[str]:
        """Files in whose range an asked name lies. One row a file reaches the driver, whatever the records or names."""
        ranges = [(r["low"], r["high"], r["file"]) for r in self.files.orderBy("low").collect()]
        lows = [r[0] for r in ranges]

        def place(names: pa.Array) -> pa.Array:
            return pa.array([bisect_right(lows, n) - 1 if n is not None else -1 for n in names.to_pylist()], pa.int32())

        places = asked.select(F.arrow_udf(place, "int")(F.col(self.name)).alias("place"), self.name)
        met = places.groupBy("place").agg(F.min(self.name).alias("least")).where("place >= 0").collect()
        return [ranges[r["place"]][2] for r in met if r["least"] <= ranges[r["place"]][1]]

    def records(self, asked: DataFrame) -> DataFrame:
        """The records that may have one of the asked names, from the matching files and row groups."""
        files = self.matching_files(asked.select(self.name))
        if not files:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(*files)
        few = [r[0] for r in asked.select(self.name).where(F.col(self.name).isNotNull()).distinct().limit(SCAN_NAMES + 1).collect()]
        if len(few) <= SCAN_NAMES:
            # equalities reach the statistics and Bloom filters of the row groups; a long IN list would not
            found = found.where(reduce(or_, [F.col(self.name) == n for n in few]))
        return found

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Every asked row with each record of its name; the record columns are null when there is none."""
        return lookup_by_name(asked, self.records(asked), self.name)

    def names(self) -> DataFrame:
        """The distinct names, in no order; only their column is read."""
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.name).distinct()


def build_name_index(records: DataFrame, name: str, files: int | None = None, group_bytes: int = GROUP_BYTES) -> NameIndex:
    """Write ``records`` sorted by ``name`` to ``files`` ranges (as many as shuffle partitions by default).

    Records without a name cannot be found and are left out. Equal names stand in one file.
    """
    spark = records.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = records.where(F.col(name).isNotNull())
    path = fresh_path(spark, "name-index")
    (
        named.repartitionByRange(parts, name).sortWithinPartitions(name)
        .write.option(f"parquet.bloom.filter.enabled#{name}", "true").option("parquet.block.size", group_bytes)
        .parquet(path)
    )
    held = spark.read.schema(records.schema).parquet(path).select(F.col("_metadata.file_path").alias("file"), name)
    ranges = held.groupBy("file").agg(F.min(name).alias("low"), F.max(name).alias("high"))
    return NameIndex(spark, path, name, records.schema, spark.read.parquet(write_fresh(ranges, "name-ranges")))


def lookup_by_name(asked: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """Every asked row with each record of its name, by a join that cuts a name asked for very often.

    Its pieces go by the other columns of the asked rows. Rows that have no other are equal, so they are
    counted before the join and repeated after it.
    """
    others = [c for c in asked.columns if c != name]
    if others:
        return lookup_join(asked, records, [name], spread=others)
    counted = asked.groupBy(name).agg(F.count(F.lit(1)).alias("_times"))
    joined = lookup_join(counted, records, [name], spread=[name])
    return joined.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_time", "_times")
