"""Streaming queries over files; all input is taken as available and the job ends by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.registry import query
from quillwork.sources.storage import fresh_path
from quillwork.sources.tables import table
from quillwork.streaming import counts


def _stream(spark, sf, name):
    """The table as a stream, whether it is one file or a folder of files: a pattern that matches its name only."""
    own = counts.stream_session(spark)
    return counts.file_stream(own, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


@query(
    "stream_word_count",
    """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word""",
)
def stream_word_count(spark, sf):
    lines = _stream(spark, sf, "documents").select("text")
    return counts.running_count(spark, counts.words(lines, "text"), ["word"], ["word"])


@query(
    "stream_batch_count",
    """SELECT doc_id % 4 AS part, word, count(*) AS n
       FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1, 2""",
)
def stream_batch_count(spark, sf, files=4):
    docs = table(spark, sf, "documents").select("text", (F.col("doc_id") % files).alias("part"))
    # the manifest tells which files, and so which part, a batch was
    counted = counts.part_words(spark, docs, "part", "text")
    part = F.regexp_extract(F.col("files")[0], r"/part=(-?\d+)/", 1)
    return counted.select(F.when(part != "", part).cast("bigint").alias("part"), "word", "n")


@query(
    "stream_sliding_count",
    """SELECT w AS window_start, event_type, count(*) AS n
       FROM (SELECT event_type, unnest([time_bucket(INTERVAL 10 SECOND, ts),
                                        time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 10 SECOND]) AS w FROM events)
       GROUP BY 1, 2""",
)
def stream_sliding_count(spark, sf):
    events = _stream(spark, sf, "events").select("ts", "event_type")
    return counts.sliding_count(spark, events, "ts", "event_type", "20 seconds", "10 seconds", watermark="1 hour")


def _messages(events):
    """A text with two hashtags for each event."""
    message = F.concat_ws(
        " ",
        F.lit("seen"),
        F.concat(F.lit("#"), F.col("event_type")),
        F.concat(F.lit("#K"), F.get_json_object("props", "$.k")),
    )
    return events.select("event_id", message.alias("text"))


_TAGS = "SELECT event_id, unnest([lower('#' || event_type), lower('#K' || json_extract_string(props, '$.k'))]) AS tag FROM events"


@query(
    "stream_hashtag_topk",
    f"SELECT tag, count(*) AS count FROM ({_TAGS}) GROUP BY tag ORDER BY count DESC, tag LIMIT 10",
)
def stream_hashtag_topk(spark, sf):
    counts.hashtag_topk(spark, _messages(_stream(spark, sf, "events")).select("text"), "text", 10, "quillwork_tags")
    return spark.sql("SELECT tag, count FROM quillwork_tags")


@query(
    "stream_live_table",
    f"""(SELECT 0 AS reading, tag, count(*) AS count FROM ({_TAGS}) WHERE event_id % 2 = 0 GROUP BY tag ORDER BY count DESC, tag LIMIT 10)
        UNION ALL
        (SELECT 1 AS reading, tag, count(*) AS count FROM ({_TAGS}) GROUP BY tag ORDER BY count DESC, tag LIMIT 10)""",
)
def stream_live_table(spark, sf):
    """The live table read twice by SQL while the stream runs: after the even events, and after all of them."""
    messages = _messages(table(spark, sf, "events"))
    folder = fresh_path(spark, "live-input")
    own = counts.stream_session(spark)
    own.createDataFrame([], messages.schema).write.parquet(folder)
    lines = counts.file_stream(own, folder, messages.schema)
    running, live = counts.live_hashtags(own, lines, "text", 10, every="500 milliseconds")
    readings = []
    with running:
        for turn in (0, 1):
            messages.where(F.col("event_id") % 2 == turn).write.mode("append").parquet(folder)
            if not running.wait_until_idle(600, quiet=3):
                raise TimeoutError("the stream did not come to rest")
            # a version never changes, so it may be read after the next one is there
            readings.append(spark.read.schema(live.schema).parquet(f"{live.path}/versions/{live.latest()}").select(F.lit(turn).alias("reading"), "tag", "count"))
    return readings[0].unionByName(readings[1])


@query(
    "stream_tumbling_append",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events
       WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
       GROUP BY 1, 2""",
)
def stream_tumbling_append(spark, sf):
    events = _stream(spark, sf, "events").select("ts", "event_type")
    return counts.closed_windows(spark, events, "ts", "event_type", "1 day", "1 hour")
