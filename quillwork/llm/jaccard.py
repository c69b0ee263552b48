"""N-gram Jaccard join over a token-group matrix.

Equal shingle sets become one class. Classes with the same smallest shingle (of frequent ones, where
these prevail) form a group, cut where it is large. The matrix says which tokens a group holds. Two sets of the wanted similarity share a
few tokens among the first ones of each in any common order, so only groups that share so many of them meet;
tokens that prove frequent go to the end of the order, by a bitmap of fixed size.
Of a pair of groups, a set whose overlap with the other group's token union is too small is left out,
and the group is opened for the others: overlaps with its members are counted token by token, and
decided exactly. Pairs whose sets are in one component already are not opened: no component would change.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.bitmaps import bitmap, contains
from quillwork.llm.common import small_batches, stored
from quillwork.llm.components import Forest, components, contract
from quillwork.llm.hashing import by_bytes, shingles
from quillwork.llm.registry import llm_query
from quillwork.sources.tables import table

#: Classes in a group.
GROUP_CLASSES = 256
#: Tokens of a group's sets, so that a block of very long texts has a largest size, too.
GROUP_TOKENS = 1_000_000
#: Tokens that similar sets must share among their first ones, if they have so many; each makes the first ones one longer.
SHARED_FIRST = 3
#: Tokens counted more often than this are frequent.
FREQUENT = 64
#: Tokens that a task counts at once.
HELD_TOKENS = 600_000
#: Texts counted at once that must share a token outside their first ones for it to be counted there.
SHARED_TEXTS = 3


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of n tokens with any similar set."""
    return -(-percent * n // 100)


def _first(tokens: np.ndarray, percent: int, frequent: np.ndarray | None) -> np.ndarray:
    """The tokens of a sorted set that hold SHARED_FIRST of any similar set's first ones, in the common order.

    Sets with a overlapping tokens share k of them among the first n - a + k of each, as at most a - k of
    either side's come later. Sets that need fewer overlapping tokens than k share all of them.
    """
    if frequent is not None:
        late = contains(frequent, tokens)
        if late.any():
            tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[: len(tokens) - _need(len(tokens), percent) + SHARED_FIRST]


def _head(tokens: np.ndarray, frequent: np.ndarray) -> int | None:
    """The token by which a set is grouped. Where frequent ones prevail, a rare one would set similar sets apart."""
    if not len(tokens):
        return None
    late = contains(frequent, tokens)
    return int((tokens[late] if 2 * late.sum() >= len(tokens) else tokens)[:1].view(np.int64)[0])


def _sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def frequent_tokens(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """A bitmap of the tokens that go to the end of the order."""

    def counts(batches):
        """First tokens, once per text, and any token that several of about a thousand texts share."""
        sets, held = [], 0

        def counted():
            every, times = np.unique(np.concatenate(sets), return_counts=True)
            every, times = every[times >= SHARED_TEXTS], times[times >= SHARED_TEXTS]
            first = np.concatenate([_first(s, percent, None) for s in sets])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([first, every]).view(np.int64)),
                 pa.array(np.concatenate([np.ones(len(first), dtype=np.int64), times.astype(np.int64)]))], names=["token", "n"])

        for batch in by_bytes(batches, 1):
            new = [s for s in shingles(batch.column(1), width) if len(s)]
            sets += new
            held += sum(map(len, new))
            if held > HELD_TOKENS:
                yield counted()
                sets, held = [], 0
        if sets:
            yield counted()

    counted = docs.mapInArrow(counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return bitmap(counted.where(F.col("n") > FREQUENT), "token")


def signatures(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """``doc_id, n, d1, d2, head, first``: set size, digest, grouping token and first tokens per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("head", pa.int64()), ("first", pa.list_(pa.int64()))])

    def sign(batches):
        for batch in by_bytes(batches, 1):
            rows = []
            for tokens in shingles(batch.column(1), width):
                digest = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), dtype=np.int64)
                first = _first(tokens, percent, frequent.value).view(np.int64) if len(tokens) else []
                head = _head(tokens, frequent.value)
                rows.append((len(tokens), int(digest[0]), int(digest[1]), head, first))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, n long, d1 long, d2 long, head long, first array<long>")


def group_blocks(sets: DataFrame) -> DataFrame:
    """``g, ids, sizes, tokens``: the sets (columns g, id, tokens) of a group packed into one row."""
    schema = pa.schema([("g", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])

    def pack(batches):
        current, rows = None, []

        def packed():
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            sizes = np.array([len(r[1]) // 8 for r in rows], dtype=np.int64)
            cells = (current, ids.tobytes(), sizes.tobytes(), b"".join(r[1] for r in rows))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

        for batch in batches:
            for g, key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if current != g:
                    if rows:
                        yield packed()
                    current, rows = g, []
                rows.append((key, raw))
        if rows:
            yield packed()

    width = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        sets.repartition(width, "g").sortWithinPartitions("g", "id").select("g", "id", "tokens")
        .mapInArrow(pack, "g long, ids binary, sizes binary, tokens binary")
    )


def open_groups(pairs: DataFrame, percent: int) -> DataFrame:
    """Links between classes from rows of two blocks (ids, sizes, tokens and the other's o_ids, o_sizes,
    o_tokens); a group paired with itself has no other block. Each task contracts the links it finds."""

    def links_of(left, right, own: bool):
        """Each left set against the group on the right; sets already joined are not linked twice."""
        if len(left) == 1 and len(right) == 1 and not own:
            (a, s), (b, t) = left[0], right[0]
            at = np.searchsorted(t, s)
            common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            return [(a, b)] if a != b and 100 * common >= percent * (len(s) + len(t) - common) else []
        ids = [i for i, _ in right]
        sizes = np.array([len(t) for _, t in right])
        member = np.repeat(np.arange(len(right)), sizes)
        tokens = np.concatenate([t for _, t in right])
        order = np.argsort(tokens, kind="stable")
        tokens, member = tokens[order], member[order]
        union, begin = np.unique(tokens, return_index=True)  # the group's row of the matrix
        end = np.append(begin[1:], len(tokens))
        forest, out = Forest(), []
        for k, (a, s) in enumerate(left):
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            at = at[union[at] == s]
            if 100 * len(at) < percent * len(s):
                continue
            lengths = end[at] - begin[at]
            steps = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            overlap = np.bincount(member[steps + np.arange(lengths.sum())], minlength=len(right))
            hit = 100 * overlap >= percent * (len(s) + sizes - overlap)
            if own:
                hit[k] = False
            for j in np.flatnonzero(hit).tolist():
                if a != ids[j] and forest.join(a, ids[j]):
                    out.append((a, ids[j]))
        return out

    def members(cells):
        """Ids and sets of a block, read where they lie in the batch."""
        ids, sizes, tokens = (np.frombuffer(c.as_buffer(), dtype=kind) for c, kind in zip(cells, (np.int64, np.int64, np.uint64)))
        return list(zip(ids.tolist(), np.split(tokens, np.cumsum(sizes)[:-1])))

    def found_in(batches):
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                cells = [c[row] for c in batch.columns]
                left, own = members(cells[:3]), not cells[3].is_valid
                found += links_of(left, left if own else members(cells[3:]), own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    def run(batches):
        return contract(found_in(batches))

    return pairs.mapInArrow(run, "a long, b long")


def block_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows for ``open_groups`` from pairs x, y of groups; they are dealt by y, as one x may be paired with very many.

    A skewed join is cut into many pieces of one size; neighbouring ones go to one task, as a task of few rows costs more than they do.
    """
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = ("ids", "sizes", "tokens")
    own = pairs.where("x = y").join(blocks.withColumnRenamed("g", "x"), "x").select(
        *cells, *[F.lit(None).cast("binary").alias(f"o_{c}") for c in cells]
    )
    two = (
        pairs.where("x <> y").join(blocks.withColumnRenamed("g", "x"), "x")
        .join(blocks.toDF("y", *[f"o_{c}" for c in cells]), "y")
        .select(*cells, *[f"o_{c}" for c in cells])
    )
    return own.coalesce(width).unionByName(two.coalesce(width))


def unsettled(pairs: DataFrame, member: DataFrame, matrix: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of groups (x, y, few) where sets of different components share so many first tokens as similar ones must."""
    placed = member.join(found, "id", "left").select("g", "first", F.coalesce("component", "id").alias("c"))
    sides = placed.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    apart = (F.col("x_lo") != F.col("x_hi")) | (F.col("y_lo") != F.col("y_hi")) | (F.col("x_lo") != F.col("y_lo"))
    mixed = stored(
        pairs.join(sides.toDF("x", "x_lo", "x_hi"), "x").join(sides.toDF("y", "y_lo", "y_hi"), "y").where(apart).select("x", "y", "few"),
        "pairs",
    )
    groups = mixed.select(F.col("x").alias("g")).unionByName(mixed.select(F.col("y").alias("g"))).distinct()
    cells = stored(
        placed.join(groups, "g", "left_semi").select(F.explode("first").alias("token"), "g", "c")
        .groupBy("token", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        .join(matrix, ["token", "g"], "left_semi"),
        "matrix",
    )
    meeting = cells.toDF("token", "x", "x_lo", "x_hi").join(cells.toDF("token", "y", "y_lo", "y_hi"), "token")
    counted = meeting.where((F.col("x") < F.col("y")) & apart).groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    return counted.join(mixed, ["x", "y"]).where("k >= few").select("x", "y")


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row.

    Sets of word shingles link when 100 * intersection >= percent * union; a component has the
    smallest doc_id that links reach. Null and empty texts and texts of white space have no shingles
    and link with nothing. Rows with the same doc_id are one document; a null doc_id has a null
    component. An empty table gives no rows; other columns are not read.
    """
    with small_batches(docs.sparkSession):  # all steps in Python run here; what is returned is joins
        return _components(_sets(docs, doc_id, text), width, percent)


def _components(rows: DataFrame, width: int, percent: int) -> DataFrame:
    spark = rows.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(rows, width, percent))
    signed = stored(signatures(rows, width, percent, frequent), "signatures")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    heads = full.join(classes.select("id", "d1", "d2"), (F.col("id") == F.col("doc_id")) & (full["d1"] == classes["d1"]) & (full["d2"] == classes["d2"]), "left_semi")
    # similar sets have sizes of one band or of neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    crowded = stored(
        heads.groupBy("head", band.alias("_band"))
        .agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_CLASSES, F.sum("n") / GROUP_TOKENS)).cast("int").alias("_cuts"))
        .where("_cuts > 1"),
        "crowded",
    )

    def grouped(sets: DataFrame, key: str) -> DataFrame:
        piece = F.pmod(F.xxhash64(key), F.coalesce("_cuts", F.lit(1)))
        return sets.withColumn("_band", band).join(crowded, ["head", "_band"], "left").withColumn(
            "g", F.xxhash64("head", "_band", piece)
        )

    member = stored(grouped(heads, "doc_id").select(F.col("doc_id").alias("id"), "n", "g", "first"), "classes")
    # dealt by token once: the distinct cells, the tokens of several groups and their join all go by it
    width_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = member.select(F.explode("first").alias("token"), "g").repartition(width_, "token").distinct()
    met = cells.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    matrix = stored(cells.join(met, "token", "left_semi"), "matrix")
    sizes = member.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    shared = (
        matrix.select("token", F.col("g").alias("x")).join(matrix.select("token", F.col("g").alias("y")), "token")
        .where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
        .join(sizes.toDF("x", "x_least", "x_most"), "x").join(sizes.toDF("y", "y_least", "y_most"), "y")
    )
    # Sets of sizes n <= m need an overlap of percent / (100 + percent) * (n + m). Of it, the c shared
    # first tokens are known; all other tokens of the one whose first tokens end earlier come later,
    # at most percent / 100 * m of them.
    smaller, larger = F.least("x_least", "y_least"), F.greatest("x_most", "y_most")
    missing = 100 * percent * (smaller + larger) - percent * (100 + percent) * larger
    possible = (
        (100 * F.col("x_most") >= percent * F.col("y_least"))
        & (100 * F.col("y_most") >= percent * F.col("x_least"))
        & (100 * (100 + percent) * F.col("c") >= missing)
        & (F.col("c") >= F.col("few"))
    )
    # the smallest sets of a pair of groups may need fewer overlapping tokens than SHARED_FIRST
    few = F.least(F.lit(SHARED_FIRST), F.ceil(smaller * percent / 100)).cast("bigint")
    across = shared.withColumn("few", few).where(possible).select("x", "y", "c", "few")
    inside = member.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(
        F.col("g").alias("x"), F.col("g").alias("y"), F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("few")
    )
    pairs = stored(across.unionByName(inside), "pairs")
    groups = pairs.select(F.col("x").alias("g")).unionByName(pairs.select(F.col("y").alias("g"))).distinct()
    needed = member.join(groups, "g", "left_semi").select("id")
    wanted = spark.sparkContext.broadcast(bitmap(needed.select(F.xxhash64("id").alias("h")), "h"))

    def tokens(batches):
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("head", pa.int64()), ("tokens", pa.binary())])
        for batch in by_bytes(batches, 2):
            batch = batch.filter(pa.array(contains(wanted.value, batch.column(1).to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                sets = shingles(batch.column(2), width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_head(s, frequent.value) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    # the bitmap may let other documents pass: they are in a group like theirs, and their links are true
    hashed = rows.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    sets = hashed.mapInArrow(tokens, "id long, n long, head long, tokens binary").where("n > 0")
    placed = grouped(sets, "id").select("g", "id", "tokens").join(groups, "g", "left_semi")
    # the writer looks at a page's size after each row, as a hundred blocks would be a page of very many bytes; zstd
    # needs no buffers of a page's size outside the heap, which the default codec keeps
    blocks = stored(group_blocks(placed), "blocks", compression="zstd", **{"parquet.page.size.row.check.min": 1})
    # each group meets itself and the one it shares most with; of the other pairs, those are opened that may
    # still link two components, which for a large group of near-copies are few
    nearest = pairs.where("x < y").groupBy("y").agg(F.max_by("x", F.struct("c", "x")).alias("x")).select("x", "y")
    first = stored(pairs.where("x = y").select("x", "y").unionByName(nearest), "pairs")
    begun = components(open_groups(block_pairs(blocks, first), percent), contracted=True)
    rest = stored(unsettled(pairs.select("x", "y", "few").join(first, ["x", "y"], "left_anti"), member, matrix, begun), "pairs")
    begun_links = begun.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(begun_links.unionByName(open_groups(block_pairs(blocks, rest), percent)), contracted=True)
    ids = full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "id")
    # a doc_id that several texts share joins their classes
    own = ids.groupBy("doc_id").agg(F.min("id").alias("id"))
    placed = own.join(found, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


@llm_query("op6_jaccard_join")
def op6_jaccard_join(spark, sf):
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf, "documents"), width=4, percent=85)
