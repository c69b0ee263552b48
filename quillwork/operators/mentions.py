"""Entity names: a dictionary from link anchors, finding names in texts, linking them to targets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import mentions as M
from quillwork.functions.names import NameTrie, pieces_in_lists, spans_in_lists
from quillwork.operators.lookups import BROADCAST_BYTES, estimated_bytes, lookup_join

SPANS = "array<array<struct<start:int,end:int,text:string,entity_id:string,entity_name:string>>>"
PIECES = "array<array<struct<kind:string,text:string,start:int,end:int>>>"
LINKED_PIECES = "array<array<struct<kind:string,text:string,start:int,end:int,entity_id:string,entity_name:string>>>"
# Rows whose names are Python objects at one time.
_ROWS = 256
# The target of a name that no entity is known for.
STUB_NAME, STUB_ID = "STUB_PAGE", "STUB_PAGE_ID"


def entity_dictionary(links: DataFrame, min_length: int = 1) -> DataFrame:
    """``surface, entity_id, entity_name, links``: each anchor form with its most frequent target.

    ``links`` has ``anchor_text, page, page_id`` (the target's name and id). Ties go to the smaller
    id. Anchors are counted per target first, so a frequent anchor is a few rows afterwards.
    """
    counts = (
        links.select(
            M.surface(F.col("anchor_text")).alias("surface"),
            F.col("page_id").alias("entity_id"),
            F.col("page").alias("entity_name"),
        )
        .where(F.length("surface") >= min_length)
        .groupBy("surface", "entity_id", "entity_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min_by(F.struct("entity_id", "entity_name", "n"), F.struct(-F.col("n"), F.col("entity_id")))
    return counts.groupBy("surface").agg(best.alias("e")).select(
        "surface", "e.entity_id", "e.entity_name", F.col("e.n").alias("links")
    )


def with_spans(
    rows: DataFrame,
    key: str,
    texts: Column,
    dictionary: DataFrame,
    max_words: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    found: tuple[str, Callable] = (SPANS, spans_in_lists),
) -> DataFrame:
    """``rows`` with ``_spans``: for each of the row's ``texts`` (an array) the names found in it, with their entity.

    ``found`` is the type and the function of what is given for a text; see :func:`with_pieces`.

    ``max_words`` leaves out longer names. Neither way puts a name into the plan. A dictionary whose measured size fits is sent
    to the workers, which walk each text once along a trie of it. A larger one is joined to the
    distinct phrases of the texts, cut for the numbers of words that names have, and each row walks
    along the trie of the names it holds, which is bounded by its own text.
    """
    wanted = dictionary.select("surface", "entity_id", "entity_name").where("surface <> ''")
    if max_words is not None:
        wanted = wanted.where(M.words_in(F.col("surface")) <= max_words)
    kind, in_lists = found
    lowers = F.transform(texts, lambda t: F.lower(t))
    if estimated_bytes(wanted) <= broadcast_bytes:
        names = wanted.toArrow()
        columns = (names.column(c).to_pylist() for c in ("surface", "entity_id", "entity_name"))
        sent = rows.sparkSession.sparkContext.broadcast(NameTrie(zip(*columns)))

        def find(texts: pa.Array, lowers: pa.Array) -> pa.Array:
            return in_lists(texts, lowers, repeat(sent.value))

        return rows.withColumn("_spans", F.arrow_udf(find, kind)(texts, lowers))

    lengths = [r[0] for r in wanted.select(M.words_in(F.col("surface"))).distinct().collect()]

    def cut(lowers: pa.Array) -> pa.Array:
        cutter = NameTrie(())
        return pa.array(
            [sorted(set().union(*(cutter.phrases(t, lengths) for t in row if t))) for row in lowers.to_pylist()], pa.list_(pa.string())
        )

    def find_own(texts: pa.Array, lowers: pa.Array, own: pa.Array) -> pa.Array:
        slices = (names for at in range(0, len(own), _ROWS) for names in own.slice(at, _ROWS).to_pylist())
        tries = (NameTrie((n["surface"], n["entity_id"], n["entity_name"]) for n in names or ()) for names in slices)
        return in_lists(texts, lowers, tries)

    phrases = rows.select(key, F.explode(F.arrow_udf(cut, "array<string>")(lowers)).alias("surface"))
    met = lookup_join(phrases, wanted, ["surface"], spread=[key], how="inner", broadcast_bytes=broadcast_bytes)
    own = met.groupBy(key).agg(F.collect_list(F.struct("surface", "entity_id", "entity_name")).alias("_own"))
    named = rows.join(own, key, "left")
    return named.withColumn("_spans", F.arrow_udf(find_own, kind)(texts, lowers, F.col("_own"))).drop("_own")


def with_pieces(rows: DataFrame, key: str, texts: Column, dictionary: DataFrame, *args, carried: bool = False, **options) -> DataFrame:
    """``rows`` with ``_pieces``: each of the row's ``texts`` cut at the names found in it, as :func:`with_spans` finds them.

    Text and link pieces alternate and are the text again; an empty text has none. With ``carried`` links have their entity.
    """
    found = LINKED_PIECES if carried else PIECES, partial(pieces_in_lists, carried=carried)
    return with_spans(rows, key, texts, dictionary, *args, found=found, **options).withColumnRenamed("_spans", "_pieces")


def mention_rows(
    texts: DataFrame, key: str, text: str, dictionary: DataFrame, max_words: int | None = None, entities: bool = False, **options
) -> DataFrame:
    """``key, start, end, mention``: one row per name found; with ``entities`` also ``entity_id, entity_name``."""
    found = with_spans(texts.select(key, text), key, F.array(text), dictionary, max_words, **options)
    names = ("start", "end", "mention", "entity_id", "entity_name")
    rows = found.select(key, F.inline(F.get("_spans", F.lit(0))).alias(*names))
    return rows if entities else rows.drop("entity_id", "entity_name")


def piece_rows(
    texts: DataFrame, key: str, text: str, dictionary: DataFrame, max_words: int | None = None, **options
) -> DataFrame:
    """``key, position, kind, text, start, end``: the texts cut at the names found in them."""
    found = with_pieces(texts.select(key, text), key, F.array(text), dictionary, max_words, **options)
    cut = found.select(key, F.posexplode(F.get("_pieces", F.lit(0))).alias("position", "piece"))
    return cut.select(key, "position", "piece.*")


def link_mentions(mentions: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Add ``entity_id, entity_name`` to mention rows; an unknown name gets the stub target."""
    wanted = mentions.withColumn("surface", M.surface(F.col("mention")))
    linked = lookup_join(
        wanted, entities.select("surface", "entity_id", "entity_name"), ["surface"], spread=[key, "start"]
    )
    return linked.select(
        *mentions.columns,
        F.coalesce("entity_id", F.lit(STUB_ID)).alias("entity_id"),
        F.coalesce("entity_name", F.lit(STUB_NAME)).alias("entity_name"),
    )


def spans_by_model(load: Callable[[], Callable[[str], list[tuple[int, int]]]]):
    """A vectorised function text -> spans for a recogniser of your own.

    ``load`` runs once per Python worker and batch stream, not once per row; the recogniser gives
    ``(start, end)`` character offsets.
    """

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        recognise = load()
        for texts in batches:
            yield texts.map(
                lambda t: [{"start": s, "end": e, "text": t[s:e]} for s, e in recognise(t)]
            )

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(find, f"array<{M.SPAN}>")
