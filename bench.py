"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local threads. Every query runs to a sink that
takes all rows and keeps none; the figure is the median of BENCH_RUNS runs after one warm-up run
(one run for a query whose warm-up run took over five seconds).
``python bench.py NAME ...`` times other queries; ``all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from quillwork.plans import load_all
from quillwork.registry import QUERIES
from quillwork.session import build_session

HEADLINE = [
    "yearly_mean",
    "group_mean",
    "agg_count_distinct",
    "describe_quartiles",
    "sort_desc",
    "derive_columns",
    "filter_boolean",
    "fill_mean",
    "word_count",
    "topk_tokens",
    "page_elements",
    "page_links",
    "page_text",
    "heading_paths",
    "inlink_totals",
    "mention_spans",
    "split_at_mentions",
    "link_entities",
    "synthetic_paragraphs",
    "doc_message",
    "text_tfidf",
    "text_stopwords",
    "feat_standard_scale",
    "stream_word_count",
    "stream_sliding_count",
    "ml_linear_regression",
    "ml_kmeans",
    "ml_naive_bayes_text",
]


def run(spark, key: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(wanted: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    load_all()
    keys = sorted(QUERIES) if wanted == ["all"] else wanted or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for key in keys:
        first = run(spark, key, folder)
        times = [run(spark, key, folder) for _ in range(runs if first < 5 else 1)]
        seconds[key] = round(statistics.median(times), 3)
        print(f"{key}: {seconds[key]} (first run {first:.2f})", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
