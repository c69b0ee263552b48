"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.common import stored


class Forest:
    """Union-find over numbers; the smaller root wins."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def contract(batches):
    """The links of one task as links to the smallest number of each group they form."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = np.array(list(forest.parent), dtype=np.int64)
    roots = np.array([forest.root(x) for x in nodes.tolist()], dtype=np.int64)
    for start in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[start : start + 100_000]), pa.array(roots[start : start + 100_000])], names=["a", "b"]
        )


def components(links: DataFrame, contracted: bool = False) -> DataFrame:
    """``id, component`` for every number in ``links`` (columns a, b): the smallest number it reaches.

    Links of a number to itself do nothing; numbers without links have no row. Each task first
    contracts its own links, unless the tasks that made them have ``contracted`` them; then large-star and small-star steps alternate until nothing changes.
    Every step writes its table to the shared folder, so a lost executor costs one step at most.
    """
    pairs = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    own = pairs if contracted else pairs.mapInArrow(contract, "a long, b long").where("a <> b")
    edges, seen = stored(own, "links"), None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0)).alias("h")
        ).first()
        if (state["n"], state["h"]) == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        seen = (state["n"], state["h"])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        edges = stored(small, "links")
