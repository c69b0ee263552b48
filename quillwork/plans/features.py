"""Feature transforms, splits and rebalancing."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quillwork.operators import features as ops
from quillwork.registry import query
from quillwork.sources.tables import table

_INDEXED = """WITH l AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
                         FROM orders GROUP BY o_orderpriority)"""


def _indexed(spark, sf):
    priorities = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ops.string_index(priorities, "o_orderpriority", "priority_index")


@query(
    "feat_string_index",
    f"{_INDEXED} SELECT o_orderkey, o_orderpriority, CAST(i AS DOUBLE) AS priority_index FROM orders JOIN l USING (o_orderpriority)",
)
def feat_string_index(spark, sf):
    return _indexed(spark, sf)


@query(
    "feat_one_hot",
    f"""{_INDEXED} SELECT o_orderkey, array_to_string([CASE WHEN k = i THEN '1' ELSE '0' END
                                                      for k in range((SELECT count(*) FROM l) - 1)], '') AS slots
        FROM orders JOIN l USING (o_orderpriority)""",
)
def feat_one_hot(spark, sf):
    encoded = ops.one_hot(_indexed(spark, sf), "priority_index", "encoded")
    slots = vector_to_array("encoded").cast("array<int>").cast("array<string>")
    return encoded.select("o_orderkey", F.array_join(slots, "").alias("slots"))


@query(
    "feat_assemble",
    f"""{_INDEXED} SELECT o_orderkey, o_totalprice AS f0, CAST(o_custkey AS DOUBLE) AS f1,
              CAST(i = 0 AS INTEGER)::DOUBLE AS f2, CAST(i = 1 AS INTEGER)::DOUBLE AS f3,
              CAST(i = 2 AS INTEGER)::DOUBLE AS f4, CAST(i = 3 AS INTEGER)::DOUBLE AS f5
       FROM orders JOIN l USING (o_orderpriority)""",
)
def feat_assemble(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority")
    encoded = ops.one_hot(ops.string_index(orders, "o_orderpriority", "i"), "i", "priority")
    assembled = ops.assemble(encoded, ["o_totalprice", "o_custkey", "priority"])
    values = vector_to_array("features")
    return assembled.select("o_orderkey", *[values[k].alias(f"f{k}") for k in range(6)])


@query("feat_vector_index")
def feat_vector_index(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_extendedprice")
    assembled = ops.assemble(items, ["l_linenumber", "l_tax", "l_extendedprice"])
    indexed = ops.vector_index(assembled, "features", "indexed", max_categories=10)
    return indexed.select("l_orderkey", "l_linenumber", vector_to_array("indexed").alias("indexed"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


@query(
    "feat_standard_scale",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings),
            s AS (SELECT slot, stddev_samp(v) AS sd FROM e GROUP BY slot)
       SELECT vec_id, CAST(slot AS INTEGER) AS slot, round(v / sd, 6) AS scaled FROM e JOIN s USING (slot)""",
)
def feat_standard_scale(spark, sf):
    scaled = ops.unit_deviation(_vectors(spark, sf), "features", "scaled")
    slots = scaled.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("slot", "scaled"))
    return slots.withColumn("scaled", F.round("scaled", 6))


@query(
    "feat_l2_normalize",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings),
            s AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM e GROUP BY vec_id)
       SELECT vec_id, CAST(slot AS INTEGER) AS slot, round(v / norm, 6) AS unit FROM e JOIN s USING (vec_id)""",
)
def feat_l2_normalize(spark, sf):
    unit = ops.unit_length(_vectors(spark, sf), "features", "unit")
    slots = unit.select("vec_id", F.posexplode(vector_to_array("unit")).alias("slot", "unit"))
    return slots.withColumn("unit", F.round("unit", 6))


SHARE = "CAST('0x' || substr(md5(doc_id || '#{seed}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "split_stable",
    f"""SELECT doc_id, lang, CASE WHEN {SHARE.format(seed=7)} < 0.7 THEN 'train' ELSE 'test' END AS part FROM documents""",
)
def split_stable(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    train, test = ops.stable_split(docs, "doc_id", 0.7, seed=7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "rebalance_classes",
    f"""SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0
        UNION ALL
        SELECT doc_id, quality, toxic FROM (
          SELECT *, row_number() OVER (ORDER BY {SHARE.format(seed=3)}, doc_id) AS i FROM labels WHERE toxic = 1)
        WHERE i <= (SELECT round_even(count(*) * 0.4, 0) FROM labels WHERE toxic = 1)""",
)
def rebalance_classes(spark, sf):
    return ops.rebalance(table(spark, sf, "labels"), "doc_id", "toxic", share=0.1, seed=3)
