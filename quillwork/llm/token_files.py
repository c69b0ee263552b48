"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file (all numbers little-endian) is a header of eight unsigned 64-bit numbers (magic, documents n,
ids u, bytes per id, low bits l, bytes of the low part, bytes of the high part, directory entries),
then

* the documents' doc_ids (n signed 64-bit numbers) and a bitmap of those that are null,
* the low part: the l lowest bits of each of the n + 1 boundaries, packed,
* the high part: boundary i sets bit (boundary >> l) + i,
* the directory: how many bits are set before each block of 512 bits, so that ``select`` reads one block,
* the ids.

Boundaries take l + 2 bits and a directory entry per 512 bits, instead of a 64-bit number each.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.common import slices, stored, text_list
from quillwork.llm.encoding import encoder as encoder_of
from quillwork.llm.registry import llm_query
from quillwork.sources.storage import fresh_path
from quillwork.sources.tables import table

MAGIC = 0x51_57_45_46_30_30_30_31
BLOCK = 512
#: Ids after which a file is closed; a document is never cut.
FILE_IDS = 4_000_000


class Boundaries:
    """Elias-Fano code of a non-decreasing sequence, with select."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.directory = count, low_bits, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> Boundaries:
        n = len(values)
        low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        blocks = (int(places[-1]) // BLOCK + 1) if n else 0
        bits = np.zeros(blocks * BLOCK, dtype=np.uint8)
        bits[places] = 1
        before = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))[:-1]])[:blocks]
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), before.astype(np.uint32))

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Values at the given places of the sequence; each reads one block of the high part."""
        ranks = np.asarray(ranks, dtype=np.int64)
        out = np.empty(len(ranks), dtype=np.int64)
        high = self.high.reshape(-1, BLOCK // 8)
        for start in range(0, len(ranks), 4096):
            part = ranks[start : start + 4096]
            block = np.searchsorted(self.directory, part, side="right") - 1
            # blocks without a set bit share their count with the next one: the last of them is meant
            bits = np.unpackbits(high[block], axis=1, bitorder="little")
            within = np.cumsum(bits, axis=1, dtype=np.int32) - 1
            hit = (within == (part - self.directory[block])[:, None]) & (bits == 1)
            place = block * BLOCK + hit.argmax(axis=1)
            value = (place - part) << self.low_bits
            for bit in range(self.low_bits):
                at = part * self.low_bits + bit
                value |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << bit
            out[start : start + 4096] = value
        return out


def write_file(sink, doc_ids: list[int | None], codes: list[bytes]) -> int:
    """Write one file; ``codes`` are the documents' ids as little-endian unsigned 32-bit numbers."""
    ids = np.frombuffer(b"".join(codes), dtype="<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    ef = Boundaries.encode(ends, len(ids))
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8), bitorder="little")
    head = [MAGIC, len(doc_ids), len(ids), width, ef.low_bits, len(ef.low), len(ef.high), len(ef.directory)]
    sink.write(np.array(head, dtype="<u8").tobytes())
    for part in (known, null, ef.low, ef.high, ef.directory.astype("<u4"), ids.astype(f"<u{width}")):
        sink.write(part.tobytes())
    return len(ids)


class TokenFile:
    """One file, read: ``offsets(i)`` gives where document i starts, ``ids(i)`` its ids."""

    def __init__(self, raw):
        head = np.frombuffer(raw, dtype="<u8", count=8).tolist()
        if head[0] != MAGIC:
            raise ValueError("not a token file")
        _, self.documents, self.total, width, low_bits, low, high, blocks = head
        at = 64

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += part.nbytes
            return part

        known, null = take("<i8", self.documents), take("u1", (self.documents + 7) // 8)
        null = np.unpackbits(null, count=self.documents, bitorder="little")
        self.doc_ids = [None if gone else int(d) for d, gone in zip(known, null)]
        self.boundaries = Boundaries(
            self.documents + 1, low_bits, take("u1", low), take("u1", high), take("<u4", blocks)
        )
        self.all_ids = take(f"<u{width}", self.total)

    def offsets(self, which) -> np.ndarray:
        return self.boundaries.select(which)

    def ids(self, document: int) -> np.ndarray:
        start, end = self.offsets([document, document + 1])
        return self.all_ids[start:end]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    blank_leads: bool = True,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode documents and write them in ascending ``doc_id`` order; one row per file.

    Rows are range-partitioned and sorted, so each task writes its own range as files of about
    ``file_ids`` ids, holding one file's ids at a time. A file is written under a name of its own
    attempt and the name goes into the returned row, so a task that runs again disturbs nothing.
    A null text is an empty document (only the end id); null doc_ids come first; repeated rows are
    documents of their own; an empty table gives no file. ``tokenizer`` must be readable on executors.

    Columns: part, file_no, path, first (ids before the file), documents, ids.
    """
    schema = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("path", pa.string()),
                        ("documents", pa.int64()), ("ids", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer, blank_leads)
        end = np.array([end_id], dtype="<u4").tobytes()
        keys, codes, size, number = [], [], 0, 0

        def close():
            path = f"{folder}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
            fs, place = _open(path)
            fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(place) as sink:
                ids = write_file(sink, keys, codes)
            row = [[part], [number], [path], [len(keys)], [ids]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

        for batch in slices(batches):
            for key, body in zip(batch.column(0).to_pylist(), text_list(batch.column(1))):
                code = encoder.encode(body) + end
                if keys and size + len(code) // 4 > file_ids:
                    yield close()
                    keys, codes, size, number = [], [], 0, number + 1
                keys.append(key)
                codes.append(code)
                size += len(code) // 4
        if keys:
            yield close()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, "_id").sortWithinPartitions("_id", "_text")
    files = stored(
        ranged.mapInArrow(write, "part int, file_no int, path string, documents long, ids long"), "token-files"
    )
    # one number per task reaches the driver; ids before a file within its task come from a window
    sizes = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part], before = before, before + sizes[part]
    spark = docs.sparkSession
    table_of_starts = spark.createDataFrame(list(starts.items()), "part int, base long")
    ahead = F.sum("ids").over(Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).join(F.broadcast(table_of_starts), "part").select(
        "part", "file_no", "path", (F.col("base") + F.col("_ahead")).alias("first"), "documents", "ids"
    )


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers. One file is in memory at
    a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, place = _open(path)
                with fs.open_input_stream(place) as source:
                    file = TokenFile(io.BytesIO(source.read()).getbuffer())
                at = file.offsets(np.arange(file.documents + 1))
                ids = file.all_ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(first + at[:-1]), pa.array(np.diff(at)),
                     pa.array(crc, pa.int64())], schema=schema)

    return files.select("path", "first").repartition(
        int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path"
    ).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@llm_query("op10_token_files")
def op10_token_files(spark, sf):
    """Write all documents as token files with boundaries in Elias-Fano code, and read them back."""
    import public_tokenizers

    folder = fresh_path(spark, "llm-tokens")
    files = write_token_files(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, folder
    )
    return read_token_files(files)
