"""The name index reads what is asked for and answers as a join does."""

import pytest
from pyspark.sql import functions as F

from quillwork.sources import nameindex


@pytest.fixture(scope="module")
def index(spark):
    records = spark.range(40_000).select(F.concat(F.lit("page "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), "id", F.repeat(F.lit("x"), 300).alias("body"))
    extra = spark.createDataFrame([(None, -1, "no name"), ("page 000007", -7, "second of its name")], "name string, id long, body string")
    return nameindex.build_name_index(records.unionByName(extra), "name", files=16, group_bytes=64 * 1024)


def _asked(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place int")


def test_lookup_answers_as_a_join(spark, index):
    names = ["page 000007", "page 039999", "page 04", "", None, "zzz", "page 020000", "page 020000", "page 000000"]
    got = sorted((r.place, r.name, r.id) for r in index.lookup(_asked(spark, names)).collect() if r.id is not None)
    assert got == sorted([(0, names[0], 7), (0, names[0], -7), (1, names[1], 39999), (6, names[6], 20000), (7, names[6], 20000), (8, names[8], 0)])
    missing = {r.place for r in index.lookup(_asked(spark, names)).collect() if r.id is None}
    assert missing == {2, 3, 4, 5}
    assert index.lookup(_asked(spark, names).limit(0)).collect() == []
    assert index.names().count() == 40_000


def _rows_read(df):
    """Rows that the scan gave out, after files and row groups were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return sum(plan.collectLeaves().apply(i).metrics().apply("numOutputRows").value() for i in range(plan.collectLeaves().size()))


def test_what_is_read_falls_with_the_names(spark, index):
    ask = lambda n: _asked(spark, [f"page {i * (40_000 // n):06d}" for i in range(n)])
    files = [len(index.matching_files(ask(n))) for n in (1, 4, 400)]
    assert files[0] == 1 and files[1] <= 4 and files[2] == 16
    one, four, many = (_rows_read(index.records(ask(n))) for n in (1, 4, 400))
    assert one < four < many == 40_001 and one <= 2_000
    assert index.matching_files(_asked(spark, ["page 9", "a", None])) == [] or _rows_read(index.records(_asked(spark, ["page 9"]))) <= 2_000


def test_a_name_asked_for_very_often(spark, index):
    hot = spark.range(30_000).select(F.lit("page 000001").alias("name")).unionByName(spark.createDataFrame([("page 000002",), (None,)], "name string"))
    counts = {r.name: r["count"] for r in index.lookup(hot).groupBy("name").count().collect()}
    assert counts == {"page 000001": 30_000, "page 000002": 1, None: 1}
