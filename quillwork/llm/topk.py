"""Exact top-k search by inner product: dual cover trees over blocks of queries and of data.

Data and queries are dealt to cells around centres from a bounded sample, and cells to blocks of
bounded size; a block holds its rows and travels as one row. A query block first searches the data
block of its own cell, which gives each query a score that k rows reach. Then cells, and of those left
their blocks, are bounded by centre and covering radius against the block's worst kth score; only
blocks that may hold a better row are searched, tree against tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.common import slices, stored
from quillwork.llm.covertree import CoverTree, search
from quillwork.llm.registry import llm_query
from quillwork.llm.vectors import matrix, raw, usable
from quillwork.sources.tables import table

#: Centres of cells at most, from a sample eight times as large.
CELLS = 64
DATA_ROWS = 1024
QUERY_ROWS = 256
#: Components beyond this count as this; scores with them are beyond 64 bits in any case.
FARTHEST = 1e150
K = 5

_BLOCK = "cell long, block int, dim int, radius double, center binary, ids binary, points binary"
_BLOCK_ARROW = pa.schema([("cell", pa.int64()), ("block", pa.int32()), ("dim", pa.int32()), ("radius", pa.float64()),
                          ("center", pa.binary()), ("ids", pa.binary()), ("points", pa.binary())])


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component; those beyond FARTHEST stand for it, so that no square is infinite."""
    return np.floor(256 * np.clip(vectors, -FARTHEST, FARTHEST))


def _centres(rows: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Far-apart sampled vectors per vector length: each next one is the farthest from those before."""
    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(8 * cells).collect():
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, vectors in drawn.items():
        points = whole(np.array(vectors))
        chosen, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < cells and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        out[dim] = points[chosen]
    return out


def _placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``cell, id, dim, point``: whole-numbered vectors with the cell of the nearest centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        schema = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("point", pa.binary())])
        for batch in slices(batches, 2048):
            sizes = np.array([len(v) for v in batch.column(1).to_pylist()])
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                points = whole(matrix(part.column(1)))
                known = shared.value.get(dim)
                near = np.zeros(len(points), dtype=np.int64)
                if known is not None:
                    near = ((known**2).sum(axis=1) - 2 * (points @ known.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dim * (CELLS + 1) + near), part.column(0), pa.array(np.full(len(points), dim, dtype=np.int32)),
                     pa.array([raw(p) for p in points], pa.binary())], schema=schema)

    return rows.mapInArrow(place, "cell long, id long, dim int, point binary")


def _packed(placed: DataFrame, limit: int) -> DataFrame:
    """Blocks of at most about ``limit`` rows of one cell. The counts by cell are a bounded table."""
    cuts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("cuts"))
    width = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        current, rows = None, []

        def packed():
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            points = np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), -1)
            center = points.mean(axis=0)
            radius = float(np.sqrt(((points - center) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
            cells = (*current, radius, raw(center), raw(ids), raw(points))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _BLOCK_ARROW)], schema=_BLOCK_ARROW)

        for batch in batches:
            for cell, block, dim, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (cell, block, dim):
                    if rows:
                        yield packed()
                    current, rows = (cell, block, dim), []
                rows.append(row)
        if rows:
            yield packed()

    return (
        placed.join(F.broadcast(cuts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        .repartition(width, "cell", "block").sortWithinPartitions("cell", "block", "id", "point")
        .select("cell", "block", "dim", "id", "point").mapInArrow(run, _BLOCK)
    )


def _tree(ids: bytes, points: bytes) -> CoverTree:
    ids = np.frombuffer(ids, dtype=np.int64)
    return CoverTree(np.frombuffer(points).reshape(len(ids), -1), ids)


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best of each pair of blocks (q_ids, q_points, worst, ids, points)."""

    def run(batches):
        last, queries, worst = None, None, None
        for batch in slices(batches, 4):
            rows = []
            for q_ids, q_points, reached, ids, points in zip(*(c.to_pylist() for c in batch.columns)):
                if last != q_ids:  # a query block often meets several data blocks in a row
                    last, queries = q_ids, _tree(q_ids, q_points)
                known = dict(zip(np.frombuffer(q_ids, dtype=np.int64).tolist(), np.frombuffer(reached).tolist())) if reached else {}
                worst = np.array([known.get(i, -np.inf) for i in queries.ids.tolist()])
                best = search(queries, _tree(ids, points), k, worst)
                rows += [(q, i, max(min(-s, 2**63 - 1), -(2**63))) for q, found in zip(queries.ids.tolist(), best.found) for s, i in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    width = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    return pairs.repartition(width).sortWithinPartitions("q_ids").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products with rows of another id.

    Components are floor(256 * x); ties go to the smaller vec_id. Both tables have ``vec_id`` and
    ``vector``. Rows whose vector is null, empty, or holds null or non-finite components, and rows
    without vec_id, take no part; vectors meet those of their own length; rows equal in id and vector
    count once. A query with fewer others gets all of them. Empty tables give no rows. Scores beyond
    64 bits are held at the limit, also those of finite components that 256 times would be infinite.
    """
    def clean(df):
        rows = df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()

    data_rows, query_rows = clean(vectors), clean(queries)
    centres = _centres(data_rows, CELLS)
    data = stored(_packed(_placed(data_rows, centres), DATA_ROWS), "data-blocks")
    asked = stored(_packed(_placed(query_rows, centres), QUERY_ROWS), "query-blocks").select(
        F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), "dim", F.col("radius").alias("q_radius"),
        F.col("center").alias("q_center"), F.col("ids").alias("q_ids"), F.col("points").alias("q_points"),
    )
    none = F.lit(None).cast("binary")
    # the first block of the query block's own cell, where the best rows are likely
    home = asked.join(data.where("block = 0").select(F.col("cell").alias("q_cell"), "ids", "points"), "q_cell")
    near = stored(_searched(home.select("q_ids", "q_points", none.alias("worst"), "ids", "points"), k), "near")
    reached = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k)

    def rows_of(batches):
        for batch in batches:
            ids = [np.frombuffer(b, dtype=np.int64) for b in batch.column(2).to_pylist()]
            sizes = [len(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes)) for c in (0, 1)]
                + [pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int64))], names=["q_cell", "q_block", "query_id"])

    members = asked.select("q_cell", "q_block", "q_ids").mapInArrow(rows_of, "q_cell long, q_block int, query_id long")
    # a block has few queries, so its scores fit one row
    known = (
        members.join(reached, "query_id", "left").groupBy("q_cell", "q_block")
        .agg(F.sort_array(F.collect_list(F.struct("query_id", F.coalesce(F.col("worst").cast("double"), F.lit(float("-inf"))).alias("w")))).alias("known"))
    )
    asked = asked.join(known, ["q_cell", "q_block"])
    # cells: a bounded table of centre and covering radius over all blocks of the cell
    heads = data.select("cell", "block", "dim", "radius", "center")
    cover: dict[int, list] = {}

    def widest(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            out = []
            for cell, dim, radius, center in rows:
                point = centres[dim][cell - dim * (CELLS + 1)] if dim in centres else np.zeros(dim)
                out.append((cell, dim, float(np.sqrt(((np.frombuffer(center) - point) ** 2).sum())) + radius))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.float64()))], names=["cell", "dim", "reach"])

    reach = heads.select("cell", "dim", "radius", "center").mapInArrow(widest, "cell long, dim int, reach double")
    for r in reach.groupBy("cell", "dim").agg(F.max("reach").alias("reach")).collect():
        point = centres[r["dim"]][r["cell"] - r["dim"] * (CELLS + 1)] if r["dim"] in centres else np.zeros(r["dim"])
        cover.setdefault(r["dim"], []).append((r["cell"], point, r["reach"] * (1 + 1e-9)))

    def bound(q_center, q_radius, center, radius):
        q, c = np.frombuffer(q_center), center
        return float(q @ c + q_radius * np.sqrt(c @ c) + radius * np.sqrt(q @ q) + q_radius * radius)

    def cells_of(batches):
        for batch in batches:
            out = []
            for cell, block, dim, radius, center, known_ in zip(*(c.to_pylist() for c in batch.columns)):
                least = min((x["w"] for x in known_), default=-np.inf)
                worst = raw(np.array([x["w"] for x in known_]))
                for other, point, reach_ in cover.get(dim, ()):
                    # whole numbers: half a unit and a trace of the bound absorb rounding
                    top = bound(center, radius, point, reach_)
                    if top + 0.5 + 1e-9 * abs(top) >= least:
                        out.append((cell, block, other, least, worst))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary()))],
                    names=["q_cell", "q_block", "cell", "least", "worst"])

    open_cells = asked.select("q_cell", "q_block", "dim", "q_radius", "q_center", "known").mapInArrow(
        cells_of, "q_cell long, q_block int, cell long, least double, worst binary"
    )
    met = (
        open_cells.join(asked.select("q_cell", "q_block", "q_radius", "q_center"), ["q_cell", "q_block"])
        .join(heads.select("cell", "block", "radius", "center"), "cell")
        .where("NOT (cell = q_cell AND block = 0)")
    )

    def blocks_of(batches):
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("q_radius", "q_center", "radius", "center", "least")}
            keep = [
                (top := bound(qc, qr, np.frombuffer(c), r)) + 0.5 + 1e-9 * abs(top) >= least
                for qr, qc, r, c, least in zip(*columns.values())
            ]
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(n) for n in ("q_cell", "q_block", "worst", "cell", "block")],
                                             names=["q_cell", "q_block", "worst", "cell", "block"])

    pairs = met.mapInArrow(blocks_of, "q_cell long, q_block int, worst binary, cell long, block int")
    full = pairs.join(asked.select("q_cell", "q_block", "known", "q_ids", "q_points"), ["q_cell", "q_block"]).join(
        data.select("cell", "block", "ids", "points"), ["cell", "block"]
    )
    far = _searched(full.select("q_ids", "q_points", "worst", "ids", "points"), k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        near.unionByName(far).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@llm_query("op1_cover_tree_topk")
def op1_cover_tree_topk(spark, sf):
    """For vectors whose id is divisible by 50, the five largest whole-numbered inner products with all others."""
    rows = table(spark, sf, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))
