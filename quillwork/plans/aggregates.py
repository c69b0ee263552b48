"""Grouped and whole-table aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators import profile
from quillwork.registry import query
from quillwork.sources.tables import spread, table

NUMERIC_ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "group_mean",
    """SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_l_quantity,
              round(avg(l_extendedprice), 4) AS mean_l_extendedprice,
              round(avg(l_discount), 6) AS mean_l_discount, round(avg(l_tax), 6) AS mean_l_tax
       FROM lineitem GROUP BY l_returnflag""",
)
def group_mean(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_returnflag").mean(*NUMERIC_ITEM)
    digits = {"l_extendedprice": 4}
    return means.select(
        "l_returnflag",
        *[F.round(F.col(f"avg({c})"), digits.get(c, 6)).alias(f"mean_{c}") for c in NUMERIC_ITEM],
    )


@query(
    "group_count",
    """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""",
)
def group_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").count().withColumnRenamed("count", "n")


@query(
    "group_min_max_sum",
    """SELECT l_linestatus, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
              round(sum(l_quantity), 2) AS sum_l_quantity,
              min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice,
              round(sum(l_extendedprice), 2) AS sum_l_extendedprice
       FROM lineitem GROUP BY l_linestatus""",
)
def group_min_max_sum(spark, sf):
    columns = ["l_quantity", "l_extendedprice"]
    measures = [
        m
        for c in columns
        for m in (
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.round(F.sum(c), 2).alias(f"sum_{c}"),
        )
    ]
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(*measures)


@query(
    "group_agg_dict",
    """SELECT o_orderstatus, max(o_totalprice) AS max_price FROM orders GROUP BY o_orderstatus""",
)
def group_agg_dict(spark, sf):
    grouped = table(spark, sf, "orders").groupBy("o_orderstatus")
    return grouped.agg({"o_totalprice": "max"}).withColumnRenamed("max(o_totalprice)", "max_price")


@query(
    "global_agg",
    """SELECT max(o_totalprice) AS max_price, min(o_totalprice) AS min_price,
              round(avg(o_totalprice), 4) AS avg_price, round(avg(o_totalprice), 4) AS mean_price,
              round(stddev_samp(o_totalprice), 4) AS stddev_price, count(o_totalprice) AS n_prices
       FROM orders""",
)
def global_agg(spark, sf):
    c = "o_totalprice"
    return table(spark, sf, "orders").agg(
        F.max(c).alias("max_price"),
        F.min(c).alias("min_price"),
        F.round(F.avg(c), 4).alias("avg_price"),
        F.round(F.mean(c), 4).alias("mean_price"),
        F.round(F.stddev(c), 4).alias("stddev_price"),
        F.count(c).alias("n_prices"),
    )


@query(
    "agg_alias",
    """SELECT count(DISTINCT l_shipdate) AS ship_days, round(avg(l_extendedprice), 4) AS average_price
       FROM lineitem""",
)
def agg_alias(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.countDistinct("l_shipdate").alias("ship_days"),
        F.round(F.avg("l_extendedprice"), 4).alias("average_price"),
    )


@query(
    "agg_count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))


@query(
    "pct_matching",
    """SELECT count(*) FILTER (WHERE o_totalprice > 300000) AS n_matching, count(*) AS n_rows,
              round(count(*) FILTER (WHERE o_totalprice > 300000) * 100.0 / count(*), 6) AS pct
       FROM orders""",
)
def pct_matching(spark, sf):
    hit = F.col("o_totalprice") > 300000
    return (
        table(spark, sf, "orders")
        .agg(F.count_if(hit).alias("n_matching"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("pct", F.round(F.try_divide(F.col("n_matching") * 100.0, F.col("n_rows")), 6))
    )


@query(
    "pearson_corr",
    """SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem""",
)
def pearson_corr(spark, sf):
    return table(spark, sf, "lineitem").select(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


_CORR = [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in NUMERIC_ITEM for b in NUMERIC_ITEM]


@query("corr_matrix", " UNION ALL ".join(_CORR))
def corr_matrix(spark, sf):
    matrix = profile.correlation_matrix(table(spark, sf, "lineitem"), NUMERIC_ITEM)
    return matrix.withColumn("r", F.round("r", 6))


@query(
    "describe_profile",
    """SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean,
              round(stddev_samp(c_acctbal), 4) AS stddev, min(c_acctbal) AS low, max(c_acctbal) AS high,
              CAST(NULL AS VARCHAR) AS low_text, CAST(NULL AS VARCHAR) AS high_text FROM customer
       UNION ALL
       SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 4),
              round(stddev_samp(c_nationkey), 4), min(c_nationkey), max(c_nationkey), NULL, NULL FROM customer
       UNION ALL
       SELECT 'c_mktsegment', count(c_mktsegment), NULL, NULL, NULL, NULL, min(c_mktsegment), max(c_mktsegment)
       FROM customer""",
)
def describe_profile(spark, sf):
    out = profile.describe_long(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"])
    return out.withColumn("mean", F.round("mean", 4)).withColumn("stddev", F.round("stddev", 4))


_QUARTILES = [
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean,
               round(stddev_samp({c}), 4) AS stddev, CAST(min({c}) AS DOUBLE) AS low,
               round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
               round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS high FROM lineitem"""
    for c in ["l_quantity", "l_extendedprice", "l_tax"]
]


@query("describe_quartiles", " UNION ALL ".join(_QUARTILES))
def describe_quartiles(spark, sf):
    out = profile.describe_quartiles(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    rounded = {"mean": 4, "stddev": 4, "q25": 6, "q50": 6, "q75": 6}
    return out.withColumns({c: F.round(c, d) for c, d in rounded.items()})


_FORMATTED = [
    f"""SELECT '{name}' AS summary, format('{{:,.2f}}', CAST(CAST({f}(o_totalprice) AS FLOAT) AS DOUBLE)) AS price,
               CAST(trunc({f}(o_custkey)) AS INTEGER) AS custkey FROM orders"""
    for name, f in [("count", "count"), ("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max")]
]


@query("describe_formatted", " UNION ALL ".join(_FORMATTED))
def describe_formatted(spark, sf):
    summary = table(spark, sf, "orders").describe("o_totalprice", "o_custkey")
    return summary.select(
        "summary",
        F.format_number(F.col("o_totalprice").cast("float"), 2).alias("price"),
        F.col("o_custkey").cast("double").cast("int").alias("custkey"),
    )


@query(
    "yearly_mean",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year,
              format('{:,.2f}', avg(o_totalprice)) AS mean_price
       FROM orders GROUP BY 1""",
)
def yearly_mean(spark, sf):
    return (
        table(spark, sf, "orders")
        .withColumn("order_year", F.year("o_orderdate"))
        .groupBy("order_year")
        .mean("o_totalprice")
        .select("order_year", F.format_number("avg(o_totalprice)", 2).alias("mean_price"))
    )


@query(
    "monthly_mean",
    """SELECT CAST(month(o_orderdate) AS INTEGER) AS order_month, round(avg(o_totalprice), 4) AS mean_price
       FROM orders GROUP BY 1""",
)
def monthly_mean(spark, sf):
    by_month = table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("order_month"))
    return by_month.agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query(
    "yearly_max",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, max(o_totalprice) AS max_price
       FROM orders GROUP BY 1""",
)
def yearly_max(spark, sf):
    by_year = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("order_year"))
    return by_year.agg(F.max("o_totalprice").alias("max_price"))


@query(
    "word_count",
    """SELECT word, count(*) AS n
       FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word""",
)
def word_count(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select(F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_balance",
    """SELECT toxic, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM labels), 6) AS share
       FROM labels GROUP BY toxic""",
)
def class_balance(spark, sf):
    return profile.class_balance(table(spark, sf, "labels"), "toxic").withColumn("share", F.round("share", 6))
