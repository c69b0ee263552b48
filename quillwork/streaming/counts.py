"""Word, hashtag and event counts over streams.

Results go through ``foreachBatch`` to Parquet, one folder per batch that a repeated batch writes
again, so a restarted job neither loses nor doubles counts and nothing is gathered at the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from quillwork.sources.storage import fresh_path, shared_folder
from quillwork.streaming.live import BatchProgress, LiveTable, Running, start


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams, with one state partition per core; settings do not leak.

    Its time zone is UTC, so event times without a zone keep their reading.
    """
    shared_folder(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return own


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files of a folder as a stream; the folder may be a pattern. For a line socket, swap in ``format("socket")``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_end(
    stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str, every: str | None = None, seconds: float = 3600,
    states: list[dict] | None = None, checkpoint: str | None = None,
) -> None:
    """Feed every micro-batch to ``each``: all available input once, or a batch per ``every`` interval.

    With an interval the stream is ended when nothing more has come for three intervals' time or
    ``seconds`` are over, whichever is first. ``states`` takes the state's rows and late rows of the last batches.
    Without an interval, a ``checkpoint`` folder of an earlier run goes on where that run ended.
    """
    if every:
        with start(stream, each, mode, every) as running:
            quiet = 3 * max(1.0, float(every.split()[0]) if "second" in every and "milli" not in every else 1.0)
            running.wait_until_idle(seconds, quiet)
        return
    running = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    try:
        running.awaitTermination()
        if states is not None:
            states += [
                {"batch_id": p["batchId"], "rows": sum(o["numRowsTotal"] for o in p["stateOperators"]),
                 "late": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])}
                for p in running.recentProgress
            ]
    finally:
        running.stop()


def batch_log(spark: SparkSession, stream: DataFrame, mode: str, per_batch=None, states: list[dict] | None = None) -> DataFrame:
    """Run the stream and return all rows of all batches with their ``batch_id``."""
    path = fresh_path(spark, "batches")
    ran = []

    def write(batch: DataFrame, batch_id: int) -> None:
        ran.append(batch_id)
        rows = per_batch(batch) if per_batch else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_to_end(stream, write, mode, states=states)
    if not ran:  # nothing arrived: the same columns without rows
        none = spark.createDataFrame([], stream.schema)
        return (per_batch(none) if per_batch else none).withColumn("batch_id", F.lit(0)).where("false")
    return spark.read.parquet(path)


def words(lines: DataFrame, column: str) -> DataFrame:
    """Flat-map lines to words at single blanks."""
    return lines.select(F.explode(F.split(column, " ")).alias("word"))


def running_count(spark: SparkSession, stream: DataFrame, keys: list[str | Column], names: list[str]) -> DataFrame:
    """Counts over the whole stream so far.

    Each batch writes only the keys it changed; the last entry of a key is its count.
    """
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    log = batch_log(spark, counts, "update")
    return log.groupBy(*names).agg(F.max_by("n", "batch_id").alias("n"))


def batch_count(spark: SparkSession, stream: DataFrame, key: str) -> DataFrame:
    """Counts of each batch by itself, as ``batch_id, key, n``."""
    return batch_log(spark, stream, "append", lambda b: b.groupBy(key).agg(F.count(F.lit(1)).alias("n")))


def part_words(spark: SparkSession, rows: DataFrame, part: str, text: str) -> DataFrame:
    """Words counted by batch, a batch for each value of ``part``: ``batch_id, word, n, files``.

    The parts come in one after the other, each as many files as it is read in, and the stream takes what has come
    since: one batch of all files of a part. ``files`` is the manifest, the sorted files a batch was made of.
    """
    folder, path, checkpoint = (fresh_path(spark, n) for n in ("stream-input", "batches", "stream"))
    own = stream_session(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = words(batch, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")
        batch.select("_file").distinct().write.mode("overwrite").parquet(f"{path}/files/batch_id={batch_id}")

    parts = [r[0] for r in rows.select(part).distinct().orderBy(part).collect()]
    for value in parts:
        came = rows.where(F.col(part).eqNullSafe(F.lit(value)))
        came.write.mode("append").partitionBy(part).parquet(folder)
        lines = file_stream(own, folder, rows.schema).select(text, F.col("_metadata.file_path").alias("_file"))
        run_to_end(lines, write, "append", checkpoint=checkpoint)
    if not parts:
        return spark.createDataFrame([], "batch_id int, word string, n long, files array<string>")
    manifest = spark.read.parquet(f"{path}/files").groupBy("batch_id").agg(F.array_sort(F.collect_set("_file")).alias("files"))
    return spark.read.parquet(f"{path}/counts").join(F.broadcast(manifest), "batch_id").select("batch_id", "word", "n", "files")


def sliding_count(
    spark: SparkSession, stream: DataFrame, ts: str, key: str, length: str, slide: str, watermark: str | None = None,
    states: list[dict] | None = None,
) -> DataFrame:
    """``window_start, key, n`` over event-time windows that overlap.

    Without a watermark every late event counts and the state keeps all windows; with one, windows
    older than it are dropped from the state and events later than it are not counted.
    ``states`` is filled with a dict per batch: batch_id, rows (windows and keys kept) and late (windows of
    events that came too late), so that neither growth nor loss goes unseen.
    """
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("_at", watermark)
    counts = timed.groupBy(F.window("_at", length, slide), key).agg(F.count(F.lit(1)).alias("n"))
    log = batch_log(spark, counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), key, "n"), "update", states=states)
    return log.groupBy("window_start", key).agg(F.max_by("n", "batch_id").alias("n"))


def top_tags(lines: DataFrame, column: str) -> DataFrame:
    """``tag, count`` of the words that begin with a hash sign, in lower case."""
    tags = words(lines, column).select(F.lower("word").alias("tag")).where(F.startswith("tag", F.lit("#")))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def live_hashtags(
    spark: SparkSession, lines: DataFrame, column: str, k: int, every: str | None = None, checkpoint: str | None = None
) -> tuple[Running, LiveTable]:
    """Start to publish the ``k`` most frequent hashtags after every batch; the table is read while the stream runs."""
    tags = top_tags(lines, column)
    live = LiveTable(spark, tags.schema)

    def publish(batch: DataFrame, batch_id: int) -> None:
        live.publish(batch.orderBy(F.desc("count"), "tag").limit(k), batch_id)

    return start(tags, publish, "complete", every, checkpoint), live


def hashtag_topk(spark: SparkSession, lines: DataFrame, column: str, k: int, name: str) -> None:
    """Publish the ``k`` most frequent hashtags as table ``name``, replaced after every batch.

    A table of that name from an earlier run goes first; without input the table is empty.
    """
    spark.createDataFrame([], "tag string, count long").createOrReplaceTempView(name)
    path = fresh_path(spark, "hashtags")

    def publish(batch: DataFrame, batch_id: int) -> None:
        top = batch.orderBy(F.desc("count"), "tag").limit(k)
        top.write.mode("overwrite").parquet(f"{path}/{batch_id}")
        spark.read.parquet(f"{path}/{batch_id}").createOrReplaceTempView(name)

    run_to_end(top_tags(lines, column), publish, "complete")


def closed_windows(spark: SparkSession, stream: DataFrame, ts: str, key: str, length: str, watermark: str) -> DataFrame:
    """Counts of the windows the watermark has closed, each written once."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", watermark)
    counts = timed.groupBy(F.window("_at", length), key).agg(F.count(F.lit(1)).alias("n"))
    log = batch_log(spark, counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), key, "n"), "append")
    return log.drop("batch_id")


def chunk_progress(spark: SparkSession, chunks: DataFrame, chunk: str, size: str) -> DataFrame:
    """Write a stream of chunk files again, a file a chunk: ``chunk, rows, chars, rows_done, seconds, seconds_a_row``.

    ``chunk`` numbers the chunks and ``size`` is a text column whose characters are counted. A batch may hold many
    chunks, which are written side by side: ``seconds`` is a chunk's share, by rows, of what its batch took, and
    ``rows_done`` counts the chunks of a batch in their order.
    """
    progress, path = BatchProgress(spark), fresh_path(spark, "chunks")

    def write(batch: DataFrame, batch_id: int) -> int:
        batch.write.mode("overwrite").partitionBy(chunk).parquet(f"{path}/batch_id={batch_id}")
        return batch.sparkSession.read.schema(chunks.schema).parquet(f"{path}/batch_id={batch_id}").count()

    run_to_end(chunks, progress.timed(write), "append")
    written = spark.read.schema(StructType([*chunks.schema, StructField("batch_id", LongType())])).option("basePath", path).parquet(f"{path}/batch_id=*")
    sizes = written.groupBy("batch_id", chunk).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(size)).alias("chars"))
    after = F.sum("n").over(Window.partitionBy("batch_id").orderBy(F.desc(chunk))) - F.col("n")
    return progress.table().join(sizes, "batch_id").select(
        chunk, F.col("n").alias("rows"), "chars", (F.col("rows_done") - after).alias("rows_done"),
        (F.col("seconds_a_row") * F.col("n")).alias("seconds"), "seconds_a_row",
    )
