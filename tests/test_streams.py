"""Streams give the same counts as the batch, over several micro-batches."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillwork.registry import QUERIES
from quillwork.sources import writers
from quillwork.streaming import counts
from quillwork.streaming.live import BatchProgress, LiveTable, start


def _stream(spark, df, files):
    folder = writers.write_fresh(df.repartition(files, "id"), "test-stream")
    return counts.file_stream(counts.stream_session(spark), folder, df.schema, files_per_batch=1)


def test_batches_add_up_to_the_whole(spark, sf):
    per_batch = QUERIES["stream_batch_count"](spark, sf)
    assert per_batch.select("part").distinct().count() == 4
    added = {r.word: r.n for r in per_batch.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert added == {r.word: r.n for r in QUERIES["word_count"](spark, sf).collect()}


def test_running_count_over_several_batches(spark):
    df = spark.createDataFrame([(i, f"a w{i % 3}  b") for i in range(30)], "id int, line string")
    got = counts.running_count(spark, counts.words(_stream(spark, df, 3), "line"), ["word"], ["word"])
    wanted = Counter(w for i in range(30) for w in f"a w{i % 3}  b".split(" "))
    assert {r.word: r.n for r in got.collect()} == wanted


def test_sliding_count_over_several_batches(spark):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", "k") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, ts string, key string").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = counts.sliding_count(spark, _stream(spark, df, 3), "ts", "key", "20 seconds", "10 seconds")
    by_start = {r.window_start.strftime("%H:%M:%S"): r.n for r in got.collect()}
    assert by_start == {"23:59:50": 20, "00:00:00": 40, "00:00:10": 40, "00:00:20": 40, "00:00:30": 40, "00:00:40": 40, "00:00:50": 20}


def test_hashtags_are_published_as_a_table(spark):
    lines = ["#A x #b", "#a no#tag", "#B #a #c", "none"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    counts.hashtag_topk(spark, _stream(spark, df, 2), "text", 2, "test_tags")
    got = spark.sql("SELECT tag, count FROM test_tags ORDER BY count DESC, tag").collect()
    assert [tuple(r) for r in got] == [("#a", 3), ("#b", 2)]


def test_table_as_folder_gives_the_same_rows(spark, sf, tmp_path):
    """Streams over a folder of part files, over one file, and over no rows at all."""
    from quillwork.registry import QUERIES

    for name in ("events", "documents"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for key in ("stream_word_count", "stream_sliding_count", "stream_hashtag_topk"):
        one = sorted(map(tuple, QUERIES[key](spark, sf).collect()))
        assert one and one == sorted(map(tuple, QUERIES[key](spark, str(tmp_path)).collect()))


LINES = "id int, text string"


def _growing(spark, tmp_path):
    """A folder of lines, and a function that adds some."""
    folder = f"{tmp_path}/lines"
    spark.createDataFrame([], LINES).write.parquet(folder)

    def add(*lines):
        spark.createDataFrame(list(enumerate(lines)), LINES).coalesce(1).write.mode("append").parquet(folder)

    own = counts.stream_session(spark)
    return own, counts.file_stream(own, folder, spark.createDataFrame([], LINES).schema), add


def test_live_table_is_read_between_batches(spark, tmp_path):
    own, lines, add = _growing(spark, tmp_path)
    running, live = counts.live_hashtags(own, lines, "text", 2, every="200 milliseconds")
    ask = lambda: sorted(map(tuple, live.sql("SELECT tag, count FROM live_tags", "live_tags").collect()))
    with running:
        assert ask() == [] and live.latest() is None
        add("#A x #b", "#a")
        assert running.wait_until_idle(60)
        first = live.latest()
        assert ask() == [("#a", 2), ("#b", 1)]
        add("#c #c #c", "#b #b")
        assert running.wait_for_batch(first + 1, 60) and running.wait_until_idle(60)
        assert ask() == [("#b", 3), ("#c", 3)]
        # the version that was read first is still what it was
        assert sorted(map(tuple, live.read(first).collect())) == [("#a", 2), ("#b", 1)]
    assert {r.version: r.rows for r in live.versions().collect()}[live.latest()] == 2
    assert not running.query.isActive


def test_an_ended_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    own, lines, add = _growing(spark, tmp_path)
    tags = counts.top_tags(lines, "text")
    live = LiveTable(own, tags.schema)
    for part in ("#x #y", "#x"):
        add(part)
        with start(tags, live.publish, "complete", "200 milliseconds", checkpoint=f"{tmp_path}/checkpoint") as running:
            assert running.wait_until_idle(60)
    assert sorted(map(tuple, live.read().collect())) == [("#x", 2), ("#y", 1)]


def test_waits_end_and_failures_are_raised(spark, tmp_path):
    own, lines, add = _growing(spark, tmp_path)
    with start(lines, lambda batch, batch_id: None, "append", "1 second") as running:
        begin = time.monotonic()
        assert not running.wait_for_batch(5, seconds=1)
        assert time.monotonic() - begin < 20

    def fail(batch, batch_id):
        raise ValueError("no room")

    add("x")
    with start(lines, fail, "append") as running, pytest.raises(Exception, match="no room"):
        running.wait_for_batch(0, 60)


def test_interval_batches_end(spark):
    df = spark.createDataFrame([(i, f"a w{i % 3}") for i in range(30)], "id int, line string")
    seen = []
    counts.run_to_end(_stream(spark, df, 3), lambda batch, batch_id: seen.append(batch.count()), "append", every="1 second", seconds=120)
    assert len(seen) == 3 and sum(seen) == 30


def test_sliding_state_is_bounded_and_late_rows_are_counted(spark):
    def run(watermark):
        rows = [(b, f"2024-01-01 {b:02d}:00:{i % 60:02d}", "k") for b in range(8) for i in range(60)]
        rows += [(8, "2024-01-01 00:00:05", "k")] * 3 + [(8, "2024-01-01 09:00:00", "k")]
        df = spark.createDataFrame(rows, "id int, ts string, key string").withColumn("ts", F.to_timestamp_ntz("ts"))
        folder = writers.write_fresh(df.limit(0), "test-sliding")
        for b in range(9):  # one file after the other, so that batches follow time
            df.where(F.col("id") == b).coalesce(1).write.mode("append").parquet(folder)
        states = []
        stream = counts.file_stream(counts.stream_session(spark), folder, df.schema, files_per_batch=1)
        got = counts.sliding_count(spark, stream, "ts", "key", "20 seconds", "10 seconds", watermark, states)
        return {r.window_start.strftime("%H:%M:%S"): r.n for r in got.collect()}, states

    every, all_states = run(None)
    bounded, states = run("10 minutes")
    assert all_states[-1]["rows"] > 50 and max(s["rows"] for s in states) <= 21
    assert sum(s["late"] for s in all_states) == 0 and sum(s["late"] for s in states) == 2  # both windows of the late event
    assert every["00:00:00"] == bounded["00:00:00"] + 3 and every["07:00:10"] == bounded["07:00:10"] == 20


def test_progress_has_a_row_per_chunk(spark, sf):
    rows = QUERIES["ingest_progress"](spark, sf).collect()
    total = QUERIES["ingest_metrics"](spark, sf).first()
    assert all(r.timed for r in rows) and sum(r.rows for r in rows) == total.rows_done and sum(r.chars for r in rows) == total.chars_done


def test_progress_of_a_repeated_batch_is_replaced(spark):
    progress = BatchProgress(spark)
    each = progress.timed(lambda batch, batch_id: batch.count())
    for batch_id in (0, 1, 1):
        each(spark.range(10 * (batch_id + 1)), batch_id)
    got = {r.batch_id: r for r in progress.table().collect()}
    assert {b: r.rows for b, r in got.items()} == {0: 10, 1: 20} and got[0].seconds_a_row == pytest.approx(got[0].seconds / 10)
    each(spark.range(0), 2)
    assert {r.batch_id: r.seconds_a_row for r in progress.table().collect()}[2] is None


def test_chunks_of_one_batch_have_a_row_each(spark):
    rows = spark.range(23).select(F.floor(F.col("id") / 5).cast("bigint").alias("chunk"), F.lit("abc").alias("content"))
    folder = writers.write_chunks(rows, "test-progress")
    stream = counts.file_stream(counts.stream_session(spark), folder, rows.schema, files_per_batch=3)
    got = counts.chunk_progress(stream.sparkSession, stream, "chunk", "content").collect()
    assert sorted((r.chunk, r.rows, r.chars) for r in got) == [(0, 5, 15), (1, 5, 15), (2, 5, 15), (3, 5, 15), (4, 3, 9)]
    assert all(r.seconds > 0 and r.seconds_a_row * r.rows == pytest.approx(r.seconds) for r in got)
    assert len({r.seconds_a_row for r in got}) == 2  # two batches for five chunks
    done = sorted((r.rows_done, r.rows) for r in got)
    assert [d for d, _ in done] == [sum(n for _, n in done[: i + 1]) for i in range(5)]


def test_a_part_of_many_files_is_one_batch(spark):
    rows = [(i, f"a w{i % 3}  b", None if i % 5 == 4 else i % 5 - 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, line string, part int").repartition(6, "id")
    got = counts.part_words(spark, df.drop("id"), "part", "line").collect()
    assert {len(r.files) for r in got} != {1} and len({r.batch_id for r in got}) == 5
    for value in (None, -1, 0, 1, 2):
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
        mine = [r for r in got if all(f"/part={name}/" in f for f in r.files)]
        wanted = Counter(w for _, line, part in rows if part == value for w in line.split(" "))
        assert len({r.batch_id for r in mine}) == 1 and {r.word: r.n for r in mine} == wanted
    assert counts.part_words(spark, df.drop("id").limit(0), "part", "line").collect() == []
