"""Sorting, limits, arg-max, top-k, stacking and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators.positions import with_position
from quillwork.registry import query
from quillwork.sources.tables import spread, table


@query(
    "sort_asc",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position
       FROM orders""",
)
def sort_asc(spark, sf):
    prices = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_position(prices, ["o_totalprice", "o_orderkey"], "position", start=1)


@query(
    "sort_desc",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position
       FROM orders""",
)
def sort_desc(spark, sf):
    prices = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_position(prices, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "position", start=1)


@query(
    "limit_rows",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20""",
)
def limit_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy("o_orderkey").limit(20)


@query(
    "argmax_row",
    """SELECT o_orderdate, o_totalprice AS peak_price FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""",
)
def argmax_row(spark, sf):
    peak = F.max_by(F.struct("o_orderdate", "o_totalprice"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return table(spark, sf, "orders").agg(peak.alias("row")).select(
        "row.o_orderdate", F.col("row.o_totalprice").alias("peak_price")
    )


@query(
    "topk_tokens",
    """SELECT token, count(*) AS n
       FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
       GROUP BY token ORDER BY n DESC, token LIMIT 10""",
)
def topk_tokens(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    tokens = docs.select(F.explode(F.split("text", " ")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(10)


@query(
    "union_rows",
    """SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1
       UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0""",
)
def union_rows(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.where("toxic = 1").unionByName(labels.where("toxic = 0"))


@query(
    "join_on_row_key",
    """SELECT d.doc_id, d.n_chars, d.lang, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_on_row_key(spark, sf):
    features = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    target = table(spark, sf, "labels").select("doc_id", "toxic")
    return features.join(target, "doc_id")


@query(
    "distinct_values",
    """SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""",
)
def distinct_values(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()
