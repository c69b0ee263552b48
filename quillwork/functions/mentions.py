"""The form of a name, and cutting a text at the names found in it, inside one row.

Offsets count characters from 0 and the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.arrays import let

SPAN = "struct<start:int,end:int,text:string>"
_EDGE = r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$"


def surface(text: Column) -> Column:
    """The form under which a name is looked up: lower case, outer punctuation removed."""
    return F.regexp_replace(F.lower(text), _EDGE, "")


def words_in(text: Column) -> Column:
    """The number of words, counted as texts are cut into words."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+"))


def pieces_of(text: Column, spans: Column, carried: tuple[str, ...] = ()) -> Column:
    """Alternating text and link pieces; put together they are the text again.

    ``spans`` are sorted and disjoint; a link piece takes over the ``carried`` text fields of its span. Empty text between links gives no piece, so an empty text
    has no pieces at all. The text is taken apart into characters once: ``substring`` would walk it
    from the start for every piece.
    """

    def piece(kind: str, chars: Column, start: Column, end: Column, span: Column | None = None) -> Column:
        taken = [(F.lit(None).cast("string") if span is None else span[f]).alias(f) for f in carried]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.array_join(F.slice(chars, start + 1, end - start), "").alias("text"),
            start.alias("start"),
            end.alias("end"),
            *taken,
        )

    def cut(bound: Column) -> Column:
        chars, spans_ = bound["chars"], bound["spans"]
        last = F.coalesce(F.get(spans_, F.size(spans_) - 1)["end"], F.lit(0))
        pieces = F.flatten(
            F.transform(
                spans_,
                lambda s, i: F.array(
                    piece("text", chars, F.coalesce(F.get(spans_, i - 1)["end"], F.lit(0)), s["start"]),
                    piece("link", chars, s["start"], s["end"], s),
                ),
            )
        )
        rest = piece("text", chars, last, F.size(chars))
        return F.filter(F.concat(pieces, F.array(rest)), lambda p: p["end"] > p["start"])

    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return let(F.struct(chars.alias("chars"), spans.alias("spans")), cut)
