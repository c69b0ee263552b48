"""A page's markup as an array of elements in document order, and what can be read from it.

An element is a row of the page tree: ``path`` holds the ordinals from the root, so an ancestor's
path is a prefix and sorting by path gives document order. ``headings`` are those of the sections
around the element, outermost first. Everything here works inside one page
row: no shuffle is needed to take a page apart or to put it together again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.arrays import let, tail

# Control characters that mark places in the text; any found in the input are removed first.
_OPEN, _NAME, _LINK, _ANCHOR = "\x01", "\x02", "\x03", "\x04"

BODY = "struct<kind:string,text:string,page:string,page_id:string,link_section:string>"
HEADING = "struct<heading_id:string,heading:string>"
ELEMENT = (
    "struct<path:array<int>,depth:int,kind:string,heading:string,heading_id:string,para_id:string,"
    f"image_url:string,list_level:int,bodies:array<{BODY}>,headings:array<{HEADING}>>"
)
KINDS = ("section", "para", "image", "list")

# Character entities and what they stand for, in decoding order.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}


def _decoded(text: Column) -> Column:
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _marked(html: Column) -> Column:
    """The page with scripts, styles, footer and comments removed and element starts marked."""
    text = F.regexp_replace(html, r"[\x01-\x04]", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<(script|style|footer)[ >].*?</(script|style|footer)>", "")
    return F.regexp_replace(text, r"<(h1|p|li)( [^>]*)?>", f"{_OPEN}$1{_NAME}")


def _flat(markup: Column) -> Column:
    """Text of an element with its links still marked.

    Closing tags are not relied on: an element ends where the next one starts, or at the end of its
    heading, list item, navigation or article.
    """
    text = F.split(markup, r"</(h1|li|nav|article)>", 2)[0]
    text = F.regexp_replace(
        text, r'(?s)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>', f"{_LINK}$1{_ANCHOR}$2{_LINK}"
    )
    text = F.regexp_replace(text, r"<br */?>", "\n")
    text = _decoded(F.regexp_replace(text, r"<[^>]*>", ""))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _without_links(flat: Column) -> Column:
    return F.replace(F.regexp_replace(flat, r"\x03[^\x03\x04]*\x04", ""), F.lit(_LINK), F.lit(""))


def _body(kind: str, text: Column, page=None, page_id=None, section=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        text.alias("text"),
        (null if page is None else page).alias("page"),
        (null if page_id is None else page_id).alias("page_id"),
        (null if section is None else section).alias("link_section"),
    )


def _link_body(marked: Column) -> Column:
    target = F.substring_index(marked, _ANCHOR, 1)
    page_id = F.substring_index(target, "#", 1)
    sections = F.split(target, "#")
    return _body(
        "link",
        F.substring_index(marked, _ANCHOR, -1),
        page=F.substring_index(page_id, "/", -1),
        page_id=page_id,
        # a link names a section only when it gives exactly one
        section=F.when((F.size(sections) == 2) & (sections[1] != ""), sections[1]),
    )


def _bodies(flat: Column) -> Column:
    """Alternating text and link bodies; their texts put together are the element's text."""
    pieces = F.transform(
        F.split(flat, _LINK),
        lambda piece, i: F.when(i % 2 == 0, _body("text", piece)).otherwise(_link_body(piece)),
    )
    return F.filter(pieces, lambda b: (b["kind"] == "link") | (b["text"] != ""))


def _heading_id(heading: Column) -> Column:
    return F.replace(heading, F.lit(" "), F.lit("%20"))


def _element(path: Column, kind: Column, headings: Column, heading=None, level=None, flat=None) -> Column:
    null = F.lit(None).cast("string")
    heading = null if heading is None else heading
    return F.struct(
        path.alias("path"),
        F.size(path).alias("depth"),
        kind.alias("kind"),
        heading.alias("heading"),
        _heading_id(heading).alias("heading_id"),
        (null if flat is None else F.md5(_without_links(flat))).alias("para_id"),
        null.alias("image_url"),
        (F.lit(None).cast("int") if level is None else level).alias("list_level"),
        (F.array().cast(f"array<{BODY}>") if flat is None else _bodies(flat)).alias("bodies"),
        headings.alias("headings"),
    )


def _leaf(part: Column, path: Column, headings: Column) -> Column:
    """A paragraph or list item from ``name NAME-mark markup``."""
    is_item = F.startswith(part, F.lit(f"li{_NAME}"))
    return let(
        _flat(F.substring_index(part, _NAME, -1)),
        lambda flat: _element(
            path,
            F.when(is_item, "list").otherwise("para"),
            headings,
            level=F.when(is_item, F.lit(1)),
            flat=flat,
        ),
    )


def elements_of(html: Column) -> Column:
    """The page's elements in document order.

    What comes before the first heading stands at the top level; each heading opens a section that
    holds what follows it.
    """

    no_headings = F.array().cast(f"array<{HEADING}>")

    def section(text: Column, ordinal: Column) -> Column:
        def children(parts: Column, heading: Column) -> Column:
            own = F.array(F.struct(_heading_id(heading).alias("heading_id"), heading.alias("heading")))
            return F.concat(
                F.array(_element(F.array(ordinal), F.lit("section"), no_headings, heading=heading)),
                F.transform(tail(parts), lambda part, j: _leaf(part, F.array(ordinal, j), own)),
            )

        return let(
            F.split(text, _OPEN),
            lambda parts: let(_without_links(_flat(parts[0])), lambda heading: children(parts, heading)),
        )

    def page(sections: Column) -> Column:
        return let(
            tail(F.split(sections[0], _OPEN)),
            lambda top: F.concat(
                F.transform(top, lambda part, i: _leaf(part, F.array(i), no_headings)),
                F.flatten(F.transform(tail(sections), lambda text, s: section(text, F.size(top) + s))),
            ),
        )

    return let(F.split(_marked(html), f"{_OPEN}h1{_NAME}"), page)


def body_text(bodies: Column) -> Column:
    """Texts of the bodies put together without a separator."""
    return F.array_join(F.transform(bodies, lambda b: b["text"]), "")


def checked_kind(kind: Column) -> Column:
    """The kind itself; the job fails on a kind the page model does not know."""
    unknown = F.raise_error(F.concat(F.lit("not an element kind: "), F.coalesce(kind, F.lit("null"))))
    return F.when(kind.isin(*KINDS), kind).otherwise(unknown.cast("string"))


def _has_children(elements: Column, i: Column) -> Column:
    following = F.get(elements, i + 1)
    return F.coalesce(following["depth"] > F.get(elements, i)["depth"], F.lit(False))


def text_of_page(elements: Column) -> Column:
    """Texts of the childless elements joined by line breaks; headings are left out.

    A section or image without children gives one empty text. ``elements`` is in document order.
    """
    return let(
        elements,
        lambda all_: F.array_join(
            F.transform(
                F.filter(
                    F.transform(
                        all_,
                        lambda e, i: F.struct(_has_children(all_, i).alias("inner"), body_text(e["bodies"]).alias("text")),
                    ),
                    lambda e: ~e["inner"],
                ),
                lambda e: e["text"],
            ),
            "\n",
        ),
    )


def _body_markup(body: Column) -> Column:
    link = F.concat(F.lit("["), body["text"], F.lit("]("), body["page"], F.lit(")"))
    return F.when(body["kind"] == "link", link).otherwise(body["text"])


def markup_of_page(elements: Column) -> Column:
    """The page rendered as markup.

    Sections are framed by equal signs, one per level; list items carry an asterisk per level; links
    and images carry their target. Top-level elements stand on lines of their own.
    """

    def rendered(e: Column, i: Column) -> Column:
        bar = F.repeat(F.lit("="), e["depth"])
        inline = F.array_join(F.transform(e["bodies"], _body_markup), " ")
        own = (
            F.when(e["kind"] == "section", F.concat(F.lit("\n"), bar, F.lit(" "), e["heading"], F.lit(" "), bar, F.lit("\n\n")))
            .when(e["kind"] == "list", F.concat(F.repeat(F.lit("*"), e["list_level"]), F.lit(" "), inline, F.lit("\n")))
            .when(e["kind"] == "image", F.concat(F.lit("!["), e["image_url"], F.lit("]. Caption: ")))
            .otherwise(inline)
        )
        return F.concat(F.when((e["depth"] == 1) & (i > 0), "\n").otherwise(""), own)

    return F.array_join(F.transform(elements, rendered), "")
