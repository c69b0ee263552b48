"""What the plans must not hold, and what must reach the scan."""

import re

import pytest

from quillwork.registry import QUERIES

# these walk texts along a trie of names, in one Arrow function and nothing else in Python
WALKING = {"mention_spans", "split_at_mentions", "link_entities", "synthetic_page", "synthetic_paragraphs"}
NATIVE = [k for k in sorted(QUERIES) if not k.startswith(("ml_", "stream_"))]


def plan(spark, sf, key):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return QUERIES[key](spark, sf)._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", NATIVE)
def test_no_python_and_no_cross_join(spark, sf, key):
    text = plan(spark, sf, key)
    physical = text[text.index("== Physical Plan ==") :]
    for operator in ["BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]:
        assert operator not in physical
    assert physical.count("ArrowEvalPython [") <= (1 if key in WALKING else 0)
    # a window without a partition would run as one task
    assert not re.search(r"Window \[[^\n]*windowspecdefinition\((specifiedwindowframe|[^\n]*ASC)[^\n]*\], \[\w+#\d+ ASC", physical)


def test_filters_and_columns_reach_the_scan(spark, sf):
    physical = plan(spark, sf, "filter_comparison")
    assert re.search(r"PushedFilters: \[[^\]]*\(l_quantity,10", physical)
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan(spark, sf, "yearly_mean")


def test_pages_are_taken_apart_without_a_shuffle_of_their_rows(spark, sf):
    physical = plan(spark, sf, "page_text")
    physical = physical[physical.index("== Physical Plan ==") :]
    # at most the one that spreads a small input over the cores
    assert physical.count("Exchange") <= 1
    assert "SortMergeJoin" not in physical
