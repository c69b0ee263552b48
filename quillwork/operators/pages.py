"""Page trees as tables: elements, bodies, outlines, headings, types, metadata, links, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import pages as P
from quillwork.functions.arrays import let, prefix_sums, runs
from quillwork.operators.lookups import lookup_join
from quillwork.operators.mentions import STUB_ID, STUB_NAME, with_pieces

# Page type tags.
PAGE_TYPES = {0: "Article", 1: "Category", 2: "Disambiguation", 3: "Redirect"}
# Metadata tags. Tag 6 is the older form of tag 7, without counts.
META_TAGS = {
    "redirect_names": 0,
    "disambiguation_names": 1,
    "disambiguation_ids": 2,
    "category_names": 3,
    "category_ids": 4,
    "inlink_ids": 5,
}
OLD_ANCHORS, COUNTED_ANCHORS = 6, 7
# Content types of a document message.
CONTENT_TYPES = {"para": "PARAGRAPH", "image": "IMAGE", "list": "LIST"}


def page_arrays(pages: DataFrame, html: str) -> DataFrame:
    """Replace the markup column by ``elements``, the page's elements in document order."""
    return pages.withColumn("elements", P.elements_of(F.col(html))).drop(html)


def unnest(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per struct of a computed array; an empty array gives one row of nulls.

    The plain generators make Spark test the array for emptiness first, below the projection that
    computes it, so that the array would be computed twice.
    """
    return df.select(key, F.inline_outer(column))


def element_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per element."""
    return unnest(pages, key, "elements").where(F.col("path").isNotNull())


def gather_pages(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """Element rows back to one row per page; a page's elements fit one row, as they came from one."""
    fields = [c for c in elements.columns if c != key]
    ordered = F.array_sort(F.collect_list(F.struct("path", *[c for c in fields if c != "path"])))
    return elements.groupBy(key).agg(ordered.alias("elements"))


def body_rows(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per text or link body of every element."""
    return elements.select(key, "path", F.posexplode("bodies").alias("position", "b")).select(
        key,
        "path",
        "position",
        "b.kind",
        "b.text",
        "b.page",
        F.col("b.page_id").alias("target_id"),
        "b.link_section",
    )


def outline(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """The top-level sections."""
    top = elements.where((F.col("kind") == "section") & (F.col("depth") == 1))
    return top.select(key, "path", "heading_id", "heading")


def child_at(elements: DataFrame, ordinal: int, under: list[int] | None = None) -> DataFrame:
    """Children at one position: of every element, or of the element at path ``under``."""
    at = elements.where((F.col("depth") > 1) & (F.element_at("path", -1) == ordinal))
    if under is None:
        return at
    parent = F.slice("path", F.lit(1), F.col("depth") - 1)
    return at.where(parent == F.array(*[F.lit(o) for o in under]))


def heading_paths(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, path, headings``: the sections around each element, outermost first.

    Elements taken from markup carry their headings already. For a bare element table of any depth,
    an ancestor's path is a prefix of the element's, so this is an equi-join on the page and the
    prefix; only paths and headings are shuffled.
    """
    if "headings" in elements.columns:
        return elements.select(key, "path", "headings")
    sections = elements.where("kind = 'section'").select(
        key, F.col("path").alias("prefix"), F.struct("heading_id", "heading").alias("h")
    )
    lengths = F.sequence(F.lit(1), F.col("depth") - 1)
    prefixes = elements.where("depth > 1").select(
        key, "path", F.explode(F.transform(lengths, lambda n: F.slice("path", F.lit(1), n))).alias("prefix")
    )
    chains = (
        lookup_join(prefixes, sections, [key, "prefix"], spread=["path"], how="inner")
        .groupBy(key, "path")
        .agg(F.array_sort(F.collect_list(F.struct("prefix", "h"))).alias("chain"))
        .select(key, "path", F.transform("chain", lambda c: c["h"]).alias("headings"))
    )
    none = F.array().cast(f"array<{P.HEADING}>")
    top = elements.where("depth = 1").select(key, "path", none.alias("headings"))
    return top.unionByName(chains)


def page_type(tag: Column) -> Column:
    """Name of the page type; the job fails on an unknown tag."""
    name = None
    for number, label in PAGE_TYPES.items():
        name = F.when(tag == number, label) if name is None else name.when(tag == number, label)
    message = F.concat(F.lit("not a page type: "), F.coalesce(tag.cast("string"), F.lit("null")))
    return name.otherwise(F.raise_error(message).cast("string"))


def redirect_target(tag: Column, target: Column) -> Column:
    """The target, for redirects only."""
    return F.when(tag == 3, target)


def page_metadata(tags: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, tag, names, pairs`` rows to one metadata row per page.

    An empty list counts as missing. Anchors of the older tag get frequency 1; counted anchors are
    preferred where a page has both.
    """

    def listed(tag: int, column: str) -> Column:
        return F.max(F.when((F.col("tag") == tag) & (F.size(column) > 0), F.col(column)))

    once = F.transform(
        F.col("names"), lambda a: F.struct(a.alias("anchor"), F.lit(1).alias("freq"))
    )
    old = F.max(F.when((F.col("tag") == OLD_ANCHORS) & (F.size("names") > 0), once))
    return tags.groupBy(key).agg(
        *[listed(tag, "names").alias(name) for name, tag in META_TAGS.items()],
        F.coalesce(listed(COUNTED_ANCHORS, "pairs"), old).alias("inlink_anchors"),
    )


def metadata_line() -> Column:
    """The metadata of a page as text: five parts, each empty when its list is missing."""

    def part(label: str, items: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f" {label} = "), F.array_join(items, ", ")), F.lit(""))

    anchors = F.transform(
        F.col("inlink_anchors"), lambda a: F.concat(a["anchor"], F.lit(": "), a["freq"].cast("string"))
    )
    parts = [
        part("redirected", F.col("redirect_names")),
        part("disambiguated", F.col("disambiguation_names")),
        part("categories", F.col("category_names")),
        part("inlinks", F.col("inlink_ids")),
        part("inlinkAnchors", anchors),
    ]
    return F.concat(F.concat_ws(" \n", *parts), F.lit("\n"))


def link_rows(bodies: DataFrame) -> DataFrame:
    """The link bodies: where they stand, their anchor and their target."""
    return bodies.where("kind = 'link'").select(
        F.col("page_id").alias("from_page"),
        "path",
        "position",
        F.col("text").alias("anchor_text"),
        "page",
        F.col("target_id").alias("page_id"),
        "link_section",
    )


def inlink_totals(links: DataFrame) -> DataFrame:
    """``entity_id, entity_name, anchor_text, frequency``: how often each anchor leads to each target.

    One row per pair: a target with very many anchors stays many rows and is never one cell.
    """
    return links.groupBy(
        F.col("page_id").alias("entity_id"), F.col("page").alias("entity_name"), "anchor_text"
    ).agg(F.count(F.lit(1)).alias("frequency"))


def inlink_pages(links: DataFrame) -> DataFrame:
    """``entity_id, page_id``: the pages that link to each target, one row per pair."""
    return links.select(F.col("page_id").alias("entity_id"), F.col("from_page").alias("page_id")).distinct()


def _linked_bodies(pieces: Column) -> Column:
    """Text and link bodies from the pieces of a text, cut at the names found in it."""

    def body(p: Column) -> Column:
        is_link = p["kind"] == "link"
        return F.struct(
            p["kind"].alias("kind"),
            p["text"].alias("text"),
            F.when(is_link, F.coalesce(p["entity_name"], F.lit(STUB_NAME))).alias("page"),
            F.when(is_link, F.coalesce(p["entity_id"], F.lit(STUB_ID))).alias("page_id"),
            F.lit(None).cast("string").alias("link_section"),
        )

    return F.transform(pieces, body)


def synthetic_pages(
    pages: DataFrame, dictionary: DataFrame, max_words: int | None = None, key: str = "page_id", **options
) -> DataFrame:
    """Every page with the bodies of its paragraphs and list items cut anew at the names found.

    ``elements`` is the new tree; ``paragraphs`` lists the rewritten paragraphs (from paragraphs,
    list items and captions) in document order. A section without children gives no paragraph.
    """
    def holds_text(e: Column) -> Column:
        return P.checked_kind(e["kind"]).isin("para", "list")

    # elements without text keep their place, so pieces go by the place of the element
    texts = F.transform("elements", lambda e: F.when(holds_text(e), P.body_text(e["bodies"])))
    found = with_pieces(pages, key, texts, dictionary, max_words, carried=True, **options)

    def rewritten(e: Column, i: Column) -> Column:
        fresh = _linked_bodies(F.get("_pieces", i))
        return e.withField("bodies", F.when(holds_text(e), fresh).otherwise(e["bodies"]))

    new = found.withColumn("elements", F.transform("elements", rewritten)).drop("_pieces")
    paragraphs = F.transform(
        F.filter("elements", lambda e: e["kind"].isin("para", "list")),
        lambda e: F.struct(e["path"].alias("path"), e["para_id"].alias("para_id"), e["bodies"].alias("bodies")),
    )
    return new.withColumn("paragraphs", paragraphs)


def _body_links(bodies: Column) -> Column:
    """Link bodies with the character offsets of their anchors in the element's text."""

    def located(bound: Column) -> Column:
        ends = prefix_sums(F.transform(bound, lambda b: F.length(b["text"])))
        return let(
            ends,
            lambda e: F.transform(
                bound,
                lambda b, i: F.struct(
                    b["kind"].alias("kind"),
                    b["text"].alias("anchor_text"),
                    F.struct((F.get(e, i) - F.length(b["text"])).alias("start"), F.get(e, i).alias("end")).alias(
                        "anchor_text_location"
                    ),
                    b["page_id"].alias("entity_id"),
                    b["page"].alias("entity_name"),
                ),
            ),
        )

    links = F.filter(let(bodies, located), lambda b: b["kind"] == "link")
    return F.transform(links, lambda b: b.dropFields("kind"))


def _link_totals(contents: Column) -> Column:
    """Anchor counts per entity over a document's own links, by sorting them and taking runs."""
    links = F.flatten(
        F.transform(
            contents,
            lambda c: F.transform(
                c["entity_links"],
                lambda k: F.struct(
                    k["entity_id"].alias("entity_id"),
                    k["entity_name"].alias("entity_name"),
                    k["anchor_text"].alias("anchor_text"),
                ),
            ),
        )
    )
    counted = let(
        F.array_sort(links),
        lambda s: runs(
            s,
            lambda a, b: a != b,
            lambda first, run: F.struct(
                first["entity_id"].alias("entity_id"),
                first["entity_name"].alias("entity_name"),
                F.struct(first["anchor_text"].alias("anchor_text"), F.size(run).alias("frequency")).alias("anchor"),
            ),
        ),
    )
    return let(
        counted,
        lambda c: runs(
            c,
            lambda a, b: a["entity_id"] != b["entity_id"],
            lambda first, run: F.struct(
                first["entity_id"].alias("entity_id"),
                first["entity_name"].alias("entity_name"),
                F.transform(run, lambda r: r["anchor"]).alias("anchor_text_frequency"),
            ),
        ),
    )


def document_messages(pages: DataFrame, key: str, name: str) -> DataFrame:
    """One nested document record per page, from ``elements`` whose bodies hold the links.

    Content rows carry the nearest heading and all headings around them, the text, and the links
    with offsets. The link totals are those of the document itself.
    """

    def content(e: Column) -> Column:
        nearest = F.get(e["headings"], F.size(e["headings"]) - 1)
        kind = F.create_map(*[F.lit(v) for pair in CONTENT_TYPES.items() for v in pair])
        unknown = F.raise_error(F.concat(F.lit("not a content kind: "), e["kind"])).cast("string")
        return F.struct(
            F.coalesce(e["para_id"], F.array_join(e["path"].cast("array<string>"), ".")).alias("id"),
            nearest["heading_id"].alias("section_heading_id"),
            nearest["heading"].alias("section_heading_name"),
            F.transform(e["headings"], lambda h: h["heading_id"]).alias("parent_section_heading_ids"),
            F.transform(e["headings"], lambda h: h["heading"]).alias("parent_section_heading_names"),
            F.coalesce(F.try_element_at(kind, e["kind"]), unknown).alias("objects_type"),
            P.body_text(e["bodies"]).alias("text"),
            _body_links(e["bodies"]).alias("entity_links"),
            F.array_compact(F.array(e["image_url"])).alias("content_urls"),
        )

    contents = F.transform(F.filter("elements", lambda e: e["kind"] != "section"), content)
    built = pages.select(
        F.col(key).cast("string").alias("doc_id"), F.col(name).alias("doc_name"), contents.alias("document_contents")
    )
    return built.select(
        "doc_id", "doc_name", _link_totals(F.col("document_contents")).alias("entity_link_totals"), "document_contents"
    )
