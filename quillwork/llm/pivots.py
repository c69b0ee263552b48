"""Embedding near-dedup by a pivot-permutation index.

Reference vectors (pivots) come from a bounded sample; every vector is indexed. A vector is described
by its nearest pivots in order. The inverted list of a pivot holds the vectors that have it among
their NEAREST first; a vector looks into the lists of its PROBES first. Two vectors are candidates
when one looks into a list that holds the other and they share enough pivots; candidates are verified
by cosine in double precision. Lists are processed in blocks of bounded size, block against block, and
give sums and forests of links, never the pairs. A pair that meets in several lists counts in the one
of the smallest pivot. Equal vectors are one entry with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.common import slices, stored
from quillwork.llm.components import Forest, components
from quillwork.llm.registry import llm_query
from quillwork.llm.vectors import matrix, raw, usable
from quillwork.sources.tables import table

#: Reference vectors at most, of a sample four times as large.
PIVOTS = 512
#: Nearest pivots that describe a vector and whose lists hold it.
NEAREST = 8
#: Lists that a vector looks into.
PROBES = 3
#: Pivots that candidates share at least.
SHARED = 2
#: Vectors in a block.
BLOCK = 1024


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from unscaled vectors."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _apart(drawn: np.ndarray, wanted: int, most: float = 0.6) -> np.ndarray:
    """Reference vectors among the drawn ones, none near another: near ones would order similar vectors at random."""
    kept = [0]
    for k in range(1, len(drawn)):
        if len(kept) < wanted and (drawn[kept] @ drawn[k]).max() < most:
            kept.append(k)
    return drawn[kept]


def _place(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int, probes: int) -> DataFrame:
    """``pivot, id, size, near, vector``: a row per list that holds a class."""
    schema = pa.schema([("pivot", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("near", pa.binary()), ("vector", pa.binary())])
    reference = classes.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        for batch in slices(batches, 2048):
            sizes = np.array([len(v) for v in batch.column(2).to_pylist()])
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                unit = _unit(matrix(part.column(2)))
                refs = reference.value.get(dim)
                if refs is None:  # no vector of this length was drawn: all of them share one list
                    near = np.zeros((len(unit), 1), dtype=np.int32)
                else:
                    near = np.argsort(-(unit @ refs.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
                near = near + dim * (PIVOTS + 1)  # lists of different lengths are different lists
                k = near.shape[1]
                rows = np.repeat(np.arange(len(unit)), k)
                lists = [raw(x) for x in near]
                vectors = [raw(x) for x in unit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel().astype(np.int64)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)),
                     pa.array([lists[r] for r in rows.tolist()], pa.binary()),
                     pa.array([vectors[r] for r in rows.tolist()], pa.binary())], schema=schema)

    return classes.mapInArrow(place, "pivot long, id long, size long, near binary, vector binary")


def _blocks(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """``pivot, block, cuts, ids, sizes, near, vectors``: the rows of a block packed into one."""
    dealt = placed.join(cuts, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    schema = pa.schema([("pivot", pa.int64()), ("block", pa.int32()), ("cuts", pa.int32()), ("ids", pa.binary()),
                        ("sizes", pa.binary()), ("near", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        current, rows = None, []

        def packed():
            ids, sizes, near, vectors = zip(*rows)
            cells = (*current, raw(np.array(ids, dtype=np.int64)), raw(np.array(sizes, dtype=np.int64)), b"".join(near), b"".join(vectors))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

        for batch in batches:
            for pivot, block, cuts_, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (pivot, block, cuts_):
                    if rows:
                        yield packed()
                    current, rows = (pivot, block, cuts_), []
                rows.append(row)
        if rows:
            yield packed()

    width = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(width, "pivot", "block").sortWithinPartitions("pivot", "block", "id")
        .select("pivot", "block", "cuts", "id", "size", "near", "vector")
        .mapInArrow(run, "pivot long, block int, cuts int, ids binary, sizes binary, near binary, vectors binary")
    )


def _meet(pairs: DataFrame, threshold: float, probes: int, shared: int) -> DataFrame:
    """``a, b, n``: links of a forest (n null), and how many vectors a class is linked to (b null)."""

    def block(ids, sizes, near, vectors):
        ids = np.frombuffer(ids, dtype=np.int64)
        return ids, np.frombuffer(sizes, dtype=np.int64), np.frombuffer(near, dtype=np.int32).reshape(len(ids), -1), \
            np.frombuffer(vectors, dtype=np.float64).reshape(len(ids), -1)

    def find(pivot, left, right, same):
        ids_a, size_a, near_a, vec_a = left
        ids_b, size_b, near_b, vec_b = right
        look_a, look_b = (near_a[:, :probes] == pivot).any(axis=1), (near_b[:, :probes] == pivot).any(axis=1)
        names, code = np.unique(np.concatenate([near_a.ravel(), near_b.ravel()]), return_inverse=True)
        marks = np.zeros((len(ids_a) + len(ids_b), len(names)), dtype=np.float32)
        marks[np.repeat(np.arange(len(marks)), near_a.shape[1]), code.ravel()] = 1
        count = marks[: len(ids_a)] @ marks[len(ids_a) :].T  # shared pivots
        mask = (count >= min(shared, near_a.shape[1])) & (look_a[:, None] | look_b[None, :])
        if same:
            mask &= ids_a[:, None] < ids_b[None, :]
        mask &= vec_a @ vec_b.T >= threshold - 1e-6
        i, j = np.nonzero(mask)
        keep = []
        for start in range(0, len(i), 100_000):
            p, q = i[start : start + 100_000], j[start : start + 100_000]
            both = near_a[p][:, :, None] == near_b[q][:, None, :]
            rank = np.arange(near_a.shape[1])
            looked = both & ((rank[:, None] < probes) | (rank[None, :] < probes))
            first = np.where(looked.any(axis=2), near_a[p], np.iinfo(np.int32).max).min(axis=1)
            keep.append((first == pivot) & (_cosines(vec_a[p], vec_b[q]) >= threshold))
        if not keep:
            return []
        keep = np.concatenate(keep)
        i, j = i[keep], j[keep]
        out = []
        for ids, mine, theirs in ((ids_a, i, size_b[j]), (ids_b, j, size_a[i])):
            n = np.bincount(mine, theirs, len(ids)).astype(np.int64)
            out += [(int(ids[k]), None, int(n[k])) for k in np.flatnonzero(n).tolist()]
        forest = Forest()
        out += [(a, b, None) for a, b in zip(ids_a[i].tolist(), ids_b[j].tolist()) if forest.join(a, b)]
        return out

    def run(batches):
        for batch in slices(batches, 8):
            rows = []
            for pivot, same, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                rows += find(pivot, block(*cells[:4]), block(*cells[4:]), same)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "n"])

    return pairs.mapInArrow(run, "a long, b long, n long")


def near_vectors(
    embeddings: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, nearest: int = NEAREST, probes: int = PROBES, shared: int = SHARED, block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; links need cosine >= ``threshold``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    neither do vectors of different lengths. Repeated rows are vectors of their own and link with each
    other; a null vec_id links with nothing and has no component. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    classes = stored(fine.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")).select("id", "size", "v"), "classes")
    sample = classes.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(4 * pivots).collect()
    number = classes.count()
    wanted = min(pivots, max(1, int(4 * number**0.5)))
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    reference = {dim: _apart(_unit(np.array(drawn)), wanted) for dim, drawn in by_length.items()}
    placed = stored(_place(classes, reference, nearest, probes), "lists")
    # one row per list: a bounded number
    cuts = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    blocks = stored(_blocks(placed, cuts), "blocks")
    cells = ("ids", "sizes", "near", "vectors")
    left = blocks.withColumn("other", F.explode(F.sequence("block", F.col("cuts") - 1)))
    right = blocks.select("pivot", F.col("block").alias("other"), *[F.col(c).alias(f"o_{c}") for c in cells])
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.join(right.hint("shuffle_merge"), ["pivot", "other"]).select(
        "pivot", (F.col("block") == F.col("other")).alias("same"), *cells, *[f"o_{c}" for c in cells]
    )
    met = stored(_meet(pairs.repartition(max(width, spark.sparkContext.defaultParallelism)), threshold, probes, shared), "met")
    linked = met.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    found = components(met.where("b IS NOT NULL").select("a", "b"))
    per_class = (
        classes.join(linked, "id", "left").join(found, "id", "left")
        .select("v", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    good = fine.join(per_class, "v").select("vec_id", "n_links", "component_id")
    # unusable vectors have no class
    bad = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False)))
    alone = bad.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


@llm_query("op4_pivot_permutation")
def op4_pivot_permutation(spark, sf):
    """Near-duplicate embeddings by cosine of 0.9 or more."""
    return near_vectors(table(spark, sf, "embeddings"))
