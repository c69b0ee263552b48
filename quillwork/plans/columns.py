"""Projection, column creation and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators import columns as ops
from quillwork.registry import query
from quillwork.sources.tables import table


@query(
    "project_columns",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders""",
)
def project_columns(spark, sf):
    return table(spark, sf, "orders")[["o_orderkey", "o_orderdate", "o_totalprice"]]


@query(
    "derive_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
              l_quantity AS quantity_copy,
              l_quantity * 2 AS quantity_doubled,
              l_quantity + 1 AS quantity_plus_one,
              l_quantity / 2 AS quantity_halved,
              CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price
       FROM lineitem""",
)
def derive_columns(spark, sf):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        .withColumn("quantity_copy", q)
        .withColumn("quantity_doubled", q * 2)
        .withColumn("quantity_plus_one", q + 1)
        .withColumn("quantity_halved", q / 2)
        .withColumn("unit_price", F.try_divide(price, q))
    )


@query(
    "rename_columns",
    """SELECT o_orderkey AS order_id, o_orderdate AS ordered_on, o_totalprice AS total FROM orders""",
)
def rename_columns(spark, sf):
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", "o_orderdate", "o_totalprice")
        .withColumnRenamed("o_orderkey", "order_id")
        .withColumnRenamed("o_orderdate", "ordered_on")
        .withColumnRenamed("o_totalprice", "total")
    )


# Codes 0..31 are known meals-style codes; a higher code has no name and falls to the default.
@query(
    "recode_map",
    """SELECT p_partkey, p_size,
              CASE WHEN p_size > 31 THEN NULL ELSE p_size END AS size_code,
              CASE WHEN p_size > 31 THEN 'other'
                   WHEN p_size <= 10 THEN 'small'
                   WHEN p_size <= 20 THEN 'medium'
                   ELSE 'large' END AS size_name
       FROM part""",
)
def recode_map(spark, sf):
    names = {code: "small" if code <= 10 else "medium" if code <= 20 else "large" for code in range(1, 32)}
    sizes = table(spark, sf, "part").select("p_partkey", "p_size")
    coded = sizes.withColumn("size_code", F.when(F.col("p_size") <= 31, F.col("p_size")))
    return ops.recode(coded, "size_code", names, "size_name", default="other")


@query(
    "affine_rescale",
    """WITH s AS (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders)
       SELECT o_orderkey, round((o_totalprice - mu) / sd * (mu / 4.1) + 100.0, 4) AS rescaled
       FROM orders, s""",
)
def affine_rescale(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    scaled = ops.affine_rescale(orders, "o_totalprice", "rescaled", new_mean=100.0)
    return scaled.select("o_orderkey", F.round("rescaled", 4).alias("rescaled"))


@query(
    "minmax_rescale",
    """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
       SELECT c_custkey,
              round((c_acctbal - lo) / (hi - lo) * 99.0 + 1.0, 0) AS scaled_whole,
              round((c_acctbal - lo) / (hi - lo) * 99.0 + 1.0, 2) AS scaled_cents
       FROM customer, s""",
)
def minmax_rescale(spark, sf):
    balances = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    whole = ops.minmax_rescale(balances, "c_acctbal", "scaled_whole", (1.0, 100.0), digits=0)
    both = ops.minmax_rescale(whole, "c_acctbal", "scaled_cents", (1.0, 100.0), digits=2)
    return both.select("c_custkey", "scaled_whole", "scaled_cents")


@query(
    "filter_sql_string",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000""",
)
def filter_sql_string(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice < 50000").select("o_orderkey", "o_totalprice")


@query(
    "filter_comparison",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate
       FROM lineitem
       WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_discount > 0.02 AND l_tax < 0.07
         AND l_linenumber = 3""",
)
def filter_comparison(spark, sf):
    items = table(spark, sf, "lineitem")
    return (
        items.filter(items["l_quantity"] >= 10)
        .filter(items["l_quantity"] <= 40)
        .filter(items["l_discount"] > 0.02)
        .filter(items["l_tax"] < 0.07)
        .filter(items["l_linenumber"] == 3)
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    )


@query(
    "filter_boolean",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE (o_totalprice < 200000 AND NOT (o_orderstatus = 'F')) OR o_orderpriority = '1-URGENT'""",
)
def filter_boolean(spark, sf):
    o = table(spark, sf, "orders")
    keep = ((o.o_totalprice < 200000) & ~(o.o_orderstatus == "F")) | (o.o_orderpriority == "1-URGENT")
    return o.filter(keep).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "sql_view_filter",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def sql_view_filter(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("quillwork_customer")
    return spark.sql(
        "SELECT c_custkey, c_name, c_acctbal FROM quillwork_customer WHERE c_mktsegment = :segment",
        args={"segment": "BUILDING"},
    )


@query(
    "case_banding",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag,
              CASE WHEN l_quantity <= 20 + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END THEN 'none'
                   WHEN l_quantity <= 40 + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END THEN 'small'
                   ELSE 'big' END AS band
       FROM lineitem""",
)
def case_banding(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    band = ops.banded(
        F.col("l_quantity"),
        relaxed=F.col("l_returnflag") == "R",
        limits=[(20, "none"), (40, "small")],
        above="big",
        slack=5,
    )
    return items.withColumn("band", band)
