"""Missing data. The input tables hold no nulls, so cells are emptied by a rule on the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators.columns import statistics
from quillwork.registry import query
from quillwork.sources.tables import table

_GAPS = """WITH t AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
  FROM customer) """
_CELLS = ["c_name", "c_mktsegment", "c_acctbal"]


def _with_gaps(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 7 != 0, F.col("c_name")).alias("c_name"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(key % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"),
    )


@query(
    "null_counts",
    _GAPS
    + """SELECT count(*) - count(c_name) AS c_name, count(*) - count(c_mktsegment) AS c_mktsegment,
                count(*) - count(c_acctbal) AS c_acctbal, count(*) AS n_rows FROM t""",
)
def null_counts(spark, sf):
    return _with_gaps(spark, sf).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in _CELLS], F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "na_drop_any",
    _GAPS + "SELECT * FROM t WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL",
)
def na_drop_any(spark, sf):
    return _with_gaps(spark, sf).na.drop(how="any")


@query(
    "na_drop_all",
    _GAPS
    + """SELECT c_name, c_mktsegment, c_acctbal FROM t
         WHERE c_name IS NOT NULL OR c_mktsegment IS NOT NULL OR c_acctbal IS NOT NULL""",
)
def na_drop_all(spark, sf):
    return _with_gaps(spark, sf).select(*_CELLS).na.drop(how="all")


@query(
    "na_drop_thresh",
    _GAPS
    + """SELECT c_name, c_mktsegment, c_acctbal FROM t
         WHERE CAST(c_name IS NOT NULL AS INT) + CAST(c_mktsegment IS NOT NULL AS INT)
               + CAST(c_acctbal IS NOT NULL AS INT) >= 2""",
)
def na_drop_thresh(spark, sf):
    return _with_gaps(spark, sf).select(*_CELLS).na.drop(how="all", thresh=2)


@query("na_drop_subset", _GAPS + "SELECT * FROM t WHERE c_acctbal IS NOT NULL")
def na_drop_subset(spark, sf):
    return _with_gaps(spark, sf).na.drop(subset=["c_acctbal"])


@query(
    "na_fill_typed",
    _GAPS
    + """SELECT c_custkey, coalesce(c_name, 'missing') AS c_name,
                coalesce(c_mktsegment, 'missing') AS c_mktsegment, coalesce(c_acctbal, 0) AS c_acctbal FROM t""",
)
def na_fill_typed(spark, sf):
    return _with_gaps(spark, sf).na.fill("missing").na.fill(0)


@query(
    "na_fill_subset",
    _GAPS + "SELECT c_custkey, coalesce(c_name, 'No Name') AS c_name, c_mktsegment, c_acctbal FROM t",
)
def na_fill_subset(spark, sf):
    return _with_gaps(spark, sf).na.fill("No Name", subset=["c_name"])


@query(
    "fill_mean",
    _GAPS
    + """SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM t)), 4) AS c_acctbal FROM t""",
)
def fill_mean(spark, sf):
    balances = _with_gaps(spark, sf).select("c_custkey", "c_acctbal")
    mean = statistics(balances, mean=F.avg("c_acctbal"))["mean"]
    return balances.select("c_custkey", F.round(F.coalesce(F.col("c_acctbal"), mean), 4).alias("c_acctbal"))
