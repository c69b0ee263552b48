"""Suffix-array dedup: removal of every byte covered by a string that occurs elsewhere.

Shards must hold together what may repeat. In each string of ``depth`` bytes one inner substring of
ANCHOR bytes is chosen by the string's content alone (the one of smallest hash), so equal strings
choose equal anchors. Consecutive strings with equal anchors make a segment; segments whose anchor occurs
more than once are sent to a shard by the anchor's hash. Equal segments count as one with a weight.
Each shard builds its suffix array, reads repeats from common prefixes, and shards of one anchor are
merged by binary search. An anchor with very many different segments is cut again by longer anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.bitmaps import bitmap, contains
from quillwork.llm.common import stored
from quillwork.llm.hashing import Prefix, by_bytes, text_bytes
from quillwork.llm.registry import llm_query
from quillwork.llm.suffixes import repeated_starts
from quillwork.sources.tables import table

DEPTH = 400
ANCHOR = 128
#: Anchors of segments that are cut again.
LONG_ANCHOR = 392
#: Different segments of one anchor beyond which they are cut again.
CROWDED = 20_000
SHARD_BYTES = 4 << 20
#: Strings of one segment; longer segments are cut.
SEGMENT_STARTS = 1 << 16
#: Bytes of text hashed at once.
BATCH_BYTES = 2 << 20

_PLACE_BITS = 32


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive numbers, from minima to and from the edges of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, depth: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash, several) of all runs of strings with equal anchors; ``several``: not all at one place."""
    hashes = Prefix(data).windows(anchor)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    coded = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least(coded, depth - anchor + 1) & mask).astype(np.int64)
    n = len(place)
    change = np.zeros(n + 1, dtype=np.int64)
    inside = np.flatnonzero(np.diff(offsets) >= depth)
    np.add.at(change, offsets[inside], 1)
    np.add.at(change, offsets[inside + 1] - depth + 1, -1)
    valid = np.cumsum(change[:n]) > 0
    if not valid.any():
        none = np.empty(0, dtype=np.int64)
        return none, none, none, np.empty(0, dtype=np.uint64), none.astype(bool)
    # anchors of one hash go on with the same segment: a periodic text has one at every period
    chosen = hashes[place]
    other = np.append(True, chosen[1:] != chosen[:-1])
    fresh = valid & (other | np.append(True, ~valid[:-1]))
    ends = valid & (np.append(other[1:], True) | np.append(~valid[1:], True))
    first, last = np.flatnonzero(fresh), np.flatnonzero(ends)
    pieces = (last - first) // SEGMENT_STARTS + 1
    if (pieces > 1).any():  # pieces of a periodic text are equal and count as one later
        begin = np.repeat(first, pieces) + SEGMENT_STARTS * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        last = np.minimum(np.repeat(last, pieces), begin + SEGMENT_STARTS - 1)
        first = begin
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, first, last, chosen[first], place[first] != place[last]


_SEGMENT = "anchor long, c1 long, c2 long, key binary, at long, starts int, bytes binary, several boolean"
_SEGMENT_ARROW = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("key", pa.binary()),
                            ("at", pa.int64()), ("starts", pa.int32()), ("bytes", pa.binary()), ("several", pa.bool_())])


def _segment_rows(data, offsets, keys, bases, depth, anchor, wanted):
    text, first, last, hashes, several = segments(data, offsets, depth, anchor)
    if wanted is not None:
        hit = np.flatnonzero(contains(wanted, hashes))
        text, first, last, hashes, several = text[hit], first[hit], last[hit], hashes[hit], several[hit]
    raw = [data[a : b + depth].tobytes() for a, b in zip(first.tolist(), last.tolist())]
    digest = np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=16).digest() for r in raw), dtype=np.int64).reshape(-1, 2)
    at = first - offsets[text] + np.asarray(bases, dtype=np.int64)[text]
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
         pa.array([keys[t] for t in text.tolist()], pa.binary()), pa.array(at),
         pa.array((last - first + 1).astype(np.int32)), pa.array(raw, pa.binary()), pa.array(several)], schema=_SEGMENT_ARROW)


def _anchors(rows: DataFrame, depth: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            *_, hashes, several = segments(*text_bytes(batch.column(1)), depth, anchor)
            hashes = np.repeat(hashes, 1 + several)  # an anchor at several places of one segment occurs more than once
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["anchor"])

    return rows.mapInArrow(run, "anchor long")


def _cut(rows: DataFrame, depth: int, anchor: int, wanted) -> DataFrame:
    """Segments of all texts whose anchor is in the bitmap."""

    def run(batches):
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            data, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_pylist()
            yield _segment_rows(data, offsets, keys, [0] * len(keys), depth, anchor, wanted.value)

    return rows.mapInArrow(run, _SEGMENT)


def _cut_again(crowded: DataFrame, depth: int, anchor: int) -> DataFrame:
    """Segments cut into shorter ones, which know the longer one's text and place."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = part.column(2).to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                yield _segment_rows(data, offsets, part.column(0).to_pylist(), part.column(1).to_pylist(), depth, anchor, None)

    return crowded.select("key", "at", "bytes").mapInArrow(run, _SEGMENT)


def _repeated(distinct: DataFrame, depth: int) -> DataFrame:
    """``anchor, c1, c2, first, last``: repeated starts, as ranges, of different segments with their weight ``k``."""
    schema = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def solve(rows):
        """Rows of whole anchors; only those with several segments, or places in one, need the arrays."""
        alone = lambda g: len(g) == 1 and not g[0][5]
        many = [r for group in rows if not alone(group) for r in group]
        flags = repeated_starts([r[4] for r in many], depth, SHARD_BYTES) if many else []
        done = list(zip(many, flags)) + [(g[0], np.zeros(len(g[0][4]) - depth + 1, dtype=bool)) for g in rows if alone(g)]
        out = []
        for (anchor, c1, c2, k, _, _), flag in done:
            if k > 1:
                out.append((anchor, c1, c2, 0, len(flag) - 1))
            elif flag.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                out += [(anchor, c1, c2, a, b - 1) for a, b in edge.reshape(-1, 2).tolist()]
        columns = zip(*out) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        groups, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    groups.append(group)
                    group = []
                    if size > SHARD_BYTES:
                        yield solve(groups)
                        groups, size = [], 0
                group.append(row)
                size += len(row[4])
        if group:
            yield solve([*groups, group])

    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        distinct.repartition(width, "anchor").sortWithinPartitions("anchor", "c1", "c2")
        .select("anchor", "c1", "c2", "k", "bytes", "several")
        .mapInArrow(run, "anchor long, c1 long, c2 long, first int, last int")
    )


def _ranges(occurrences: DataFrame, depth: int) -> DataFrame:
    """``key, first, last``: repeated starts of texts, from their stored segments."""
    distinct = occurrences.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("k"), F.first("bytes").alias("bytes"), F.max("several").alias("several"))
    return (
        occurrences.select("anchor", "c1", "c2", "key", "at")
        .join(_repeated(distinct, depth), ["anchor", "c1", "c2"])
        .select("key", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))
    )


def repeated_ranges(rows: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, long_anchor: int = LONG_ANCHOR,
                    crowded: int = CROWDED) -> DataFrame:
    """``key, first, last``: starts of strings of ``depth`` bytes that occur elsewhere, for rows (key, text)."""
    common = _anchors(rows, depth, anchor).groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap(common, "anchor"))
    found = stored(_cut(rows, depth, anchor, wanted), "segments")
    busy = (
        found.select("anchor", "c1", "c2").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("k"))
        .where(F.col("k") > crowded).select("anchor")
    )
    busy = stored(busy, "crowded")
    plain = _ranges(found.join(busy, "anchor", "left_anti"), depth)
    if not busy.take(1):
        return plain
    again = stored(_cut_again(found.join(busy, "anchor", "left_semi"), depth, long_anchor), "segments")
    return plain.unionByName(_ranges(again, depth))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: texts without bytes that a repeated string covers.

    ``kept`` is binary, since a cut may fall within a character. Null and empty texts are empty; rows
    that are equal in id and text are repeats of each other; a null doc_id is kept. An empty table
    gives no rows, other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), body)))
    rows = docs.select(key.alias("key"), body.alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"))
    ranges = repeated_ranges(rows.select("key", "text"), depth, **sizes)
    packed = ranges.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches):
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            out = []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body, kept, spans, removed, end = body.encode(), [], 0, 0, 0
                for span in found or ():
                    first, last = span["first"], span["last"] + depth
                    if first > end or not spans:
                        kept.append(body[end:first])
                        spans += 1
                        removed += last - first
                    else:
                        removed += max(0, last - end)
                    end = max(end, last)
                kept.append(body[end:])
                out.append((len(body), removed, spans, b"".join(kept)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return rows.join(packed, "key", "left").select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


@llm_query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark, sf):
    """All documents without the bytes that a 400-byte string found elsewhere covers."""
    return remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
