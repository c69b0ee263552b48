"""Writers. Every write goes to a path that must not exist yet and is done by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillwork.operators.positions import with_position
from quillwork.sources.storage import fresh_path


def write_fresh(df: DataFrame, label: str, file_format: str = "parquet", **options) -> str:
    """Write to a new path under the shared folder and return the path."""
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").format(file_format).options(**options).save(path)
    return path


def page_rows(
    pages: DataFrame, page_id: str, page_name: str, content: str, rows_per_chunk: int = 100_000
) -> DataFrame:
    """``idx, chunk, page_id, page_name, content``: pages numbered in id order and cut into chunks.

    Only the ids, which are unique, are sorted and numbered; the contents meet their number in a join.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(page_name).alias("page_name"), F.col(content).alias("content")
    )
    numbered = with_position(rows.select("page_id"), ["page_id"], "idx")
    return rows.join(numbered, "page_id").select(
        "idx",
        F.floor(F.col("idx") / rows_per_chunk).cast("bigint").alias("chunk"),
        "page_id",
        "page_name",
        "content",
    )


def write_chunks(rows: DataFrame, label: str) -> str:
    """One Parquet file per chunk, in a folder per chunk; the last chunk may be short.

    A chunk has a set number of rows, so sending each chunk to one task keeps tasks even.
    """
    path = fresh_path(rows.sparkSession, label)
    rows.repartition("chunk").write.mode("errorifexists").partitionBy("chunk").parquet(path)
    return path


def observed_write(df: DataFrame, label: str, **metrics: Column) -> dict:
    """Write ``df`` and return the metrics gathered while the rows went by, without a second pass.

    ``df`` should come from a session of its own (``spark.newSession()``): a session that has
    observed a table can no longer be shipped with the closures of some model summaries.
    """
    seen = Observation(label)
    write_fresh(df.observe(seen, *[m.alias(n) for n, m in metrics.items()]), label)
    return seen.get
