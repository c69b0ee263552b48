"""Running streams that can be waited for and ended, and tables that are read while they run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from quillwork.sources.storage import fresh_path

POLL_SECONDS = 0.1
PROGRESS = "batch_id long, rows long, rows_done long, seconds double, seconds_a_row double"


@dataclass
class Running:
    """A started stream. Every wait has an end, and a stream that failed raises."""

    query: StreamingQuery
    done: list[int] = field(default_factory=list)

    def _wait(self, reached: Callable[[], bool], seconds: float) -> bool:
        until = time.monotonic() + seconds
        while not reached():
            if failed := self.query.exception():
                raise failed
            if not self.query.isActive or time.monotonic() > until:
                return reached()
            time.sleep(POLL_SECONDS)
        return True

    def wait_for_batch(self, batch_id: int, seconds: float = 60) -> bool:
        """True once batch ``batch_id`` has been handled; False when the time is over first."""
        return self._wait(lambda: bool(self.done) and self.done[-1] >= batch_id, seconds)

    def wait_until_idle(self, seconds: float = 60, quiet: float = 1.0) -> bool:
        """True once a batch has been handled and for ``quiet`` seconds nothing more has come."""
        since = [time.monotonic(), -1]

        def idle() -> bool:
            status = self.query.status
            if status["isDataAvailable"] or status["isTriggerActive"] or len(self.done) != since[1]:
                since[:] = [time.monotonic(), len(self.done)]
            return bool(self.done) and time.monotonic() - since[0] >= quiet

        return self._wait(idle, seconds)

    def stop(self) -> None:
        """End the stream; what has been handled stays handled."""
        self.query.stop()

    def __enter__(self) -> Running:
        return self

    def __exit__(self, *_) -> None:
        self.stop()


def start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str, every: str | None = None, checkpoint: str | None = None
) -> Running:
    """Start feeding micro-batches to ``each``: one per ``every`` interval, or as fast as they come.

    A ``checkpoint`` folder of an earlier run goes on where that run ended.
    """
    done: list[int] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        each(batch, batch_id)
        done.append(batch_id)

    writer = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "stream"))
    )
    return Running((writer.trigger(processingTime=every) if every else writer).start(), done)


class LiveTable:
    """A table replaced by every batch of a stream, which any session can read while the stream runs.

    Each batch writes a version of its own and then its commit, so a reader sees whole versions only
    and one that it has begun to read does not change. A repeated batch writes its version again.
    """

    def __init__(self, spark: SparkSession, schema: StructType, path: str | None = None):
        self.spark, self.schema = spark, schema
        self.path = path or fresh_path(spark, "live-table")
        self._commits = f"{self.path}/commits"
        # the folder is there before the first commit, so that a reader finds no version instead of no table
        spark.createDataFrame([], "version long, rows long").write.mode("append").parquet(self._commits)

    def publish(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
        n = rows.sparkSession.read.schema(self.schema).parquet(f"{self.path}/versions/{version}").count()
        commit = rows.sparkSession.createDataFrame([(version, n)], "version long, rows long")
        commit.coalesce(1).write.mode("append").parquet(self._commits)

    def versions(self) -> DataFrame:
        """``version, rows`` of what has been published."""
        return self.spark.read.schema("version long, rows long").parquet(self._commits).distinct()

    def latest(self) -> int | None:
        return self.versions().agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the latest by default; a table without rows before there is one."""
        version = self.latest() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/versions/{version}")

    def sql(self, statement: str, name: str) -> DataFrame:
        """Run a statement over the latest version, which it calls ``name``."""
        self.read().createOrReplaceTempView(name)
        return self.spark.sql(statement)


class BatchProgress:
    """One row for each batch that is handled: its rows, all rows so far, seconds, seconds a row."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "progress")
        self.rows_done = 0

    def timed(self, write: Callable[[DataFrame, int], int]) -> Callable[[DataFrame, int], None]:
        """``write`` handles a batch and returns its number of rows; a repeated batch replaces its row."""

        def each(batch: DataFrame, batch_id: int) -> None:
            begin = time.perf_counter()
            rows = write(batch, batch_id)
            seconds = time.perf_counter() - begin
            self.rows_done += rows
            row = [(batch_id, rows, self.rows_done, seconds, seconds / rows if rows else None)]
            log = batch.sparkSession.createDataFrame(row, PROGRESS)
            log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

        return each

    def table(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).parquet(f"{self.path}/batch=*")
