"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only lengths decide where a piece goes, and there are at most ``capacity`` lengths. The plan is made
on the counts of lengths: pieces over a third of the capacity meet at most one of their kind in a
sequence, so they are matched greedily, largest first with the largest that fits; smaller ones go,
largest first, into the smallest gap that holds them. A plan row places a run of equal pieces into a
run of equal sequences, so the plan stays small whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.common import slices, small_batches, stored, text_list
from quillwork.llm.encoding import KEPT_PIECES
from quillwork.llm.encoding import encoder as encoder_of
from quillwork.llm.registry import llm_query
from quillwork.sources.tables import table

CAPACITY = 4096
#: Equal pieces that one window sorts when they are numbered.
RANKED_ROWS = 20_000

_RANK_BITS = 44


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
    blank_leads: bool = False, kept: int = KEPT_PIECES,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut where too long.

    A null text is an empty document: the end id alone. Repeated rows give repeated pieces.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        encoder = encoder_of(tokenizer, blank_leads, kept)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), text_list(batch.column(1))):
                code = encoder.encode(body) + end
                for piece, at in enumerate(range(0, len(code), 4 * capacity)):
                    part = code[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, offset) that place all pieces.

    ``counts`` maps a length (1 to ``capacity``) to its pieces. Piece ``rank`` of a length goes to
    sequence ``first sequence + rank - first rank``.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    given: dict[int, int] = defaultdict(int)
    plan, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps = np.zeros(capacity + 1, dtype=bool)

    def place(length: int, n: int, first: int, offset: int) -> None:
        plan.append((length, given[length], given[length] + n, first, offset))
        given[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            gaps[gap].append((first, n))
            open_gaps[gap] = True

    large = sorted((length for length in left if 3 * length > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((x for x in large if x <= min(length, capacity - length) and left[x]), 0)
            if partner == length and left[length] == 1:
                partner = next((x for x in large if x < length and x <= capacity - length and left[x]), 0)
            if not partner:
                n = left[length]
                place(length, n, sequences, 0)
                leave(capacity - length, sequences, n)
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                place(length, n, sequences, 0)
                place(partner, n, sequences, length)
                leave(capacity - length - partner, sequences, n)
            sequences += n
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            wide = np.flatnonzero(open_gaps[length:])
            if len(wide):
                gap = length + int(wide[0])
                first, n = gaps[gap].pop()
                open_gaps[gap] = bool(gaps[gap])
            else:
                gap, first = capacity, sequences
                n = -(-left[length] // (capacity // length))
                sequences += n
            each = gap // length
            full = min(n, left[length] // each)
            for k in range(each if full else 0):
                place(length, full, first, capacity - gap + k * length)
            leave(gap - each * length, first, full)
            some = min(left[length], each) if full < n else 0
            for k in range(some):
                place(length, 1, first + full, capacity - gap + k * length)
            if some:
                leave(gap - some * length, first + full, 1)
                full += 1
            leave(gap, first + full, n - full)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns doc_id, piece, start, length, ids_crc32).

    ``pieces`` is read several times and should be stored. Equal lengths are numbered in buckets by
    hash, so a length that many documents share is spread; counts by length and bucket are small.
    An empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sorted(plan_lengths(counts, capacity))
    key = spark.sparkContext.broadcast(np.array([(p[0] << _RANK_BITS) + p[1] for p in plan], dtype=np.int64))
    put = spark.sparkContext.broadcast(np.array([(p[1], p[3], p[4]) for p in plan], dtype=np.int64).reshape(-1, 3))
    widths = spark.createDataFrame(
        [(int(length), max(1, -(-n // ranked_rows))) for length, n in counts.items()], "length long, _width int"
    )
    spread = pieces.join(F.broadcast(widths), "length").withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_width")).cast("int")
    )
    cell = Window.partitionBy("length", "_bucket")
    before = (
        spread.groupBy("length", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("length", "_bucket", "_before")
    )
    ranked = (
        spread.withColumn("_row", F.row_number().over(cell.orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(before, ["length", "_bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_row")).alias("_rank"))
    )
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()),
                        ("offset", pa.int64())])

    def assign(batches):
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(key.value, (length << _RANK_BITS) + rank, side="right") - 1
            first, sequence, offset = put.value[row].T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + rank - first), pa.array(np.ascontiguousarray(offset))],
                schema=schema,
            )

    return ranked.mapInArrow(
        assign,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, kept: int = KEPT_PIECES) -> DataFrame:
    import public_tokenizers

    with small_batches(docs.sparkSession):
        pieces = stored(cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, capacity, kept=kept), "pieces")
    return pack(pieces, capacity)


@llm_query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf):
    """All documents, tokenized and packed into sequences of at most 4096 ids."""
    return pack_documents(table(spark, sf, "documents"))
