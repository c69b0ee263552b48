"""Page trees on a small nested fixture: three levels, empty section, captions, lists, links."""

import pytest
from pyspark.sql import functions as F

from quillwork.functions import pages as P
from quillwork.operators import pages as ops
from quillwork.operators.mentions import STUB_ID

FIELDS = (
    "page_id bigint, path array<int>, depth int, kind string, heading string, heading_id string, "
    f"para_id string, image_url string, list_level int, bodies array<{P.BODY}>"
)


def text(t):
    return ("text", t, None, None, None)


def link(t, page, section=None):
    return ("link", t, page, "id:" + page, section)


def row(page, path, kind, heading=None, level=None, url=None, bodies=()):
    hid = heading.replace(" ", "%20") if heading else None
    para = f"p{page}-{'.'.join(map(str, path))}" if bodies else None
    return (page, path, len(path), kind, heading, hid, para, url, level, list(bodies))


ROWS = [
    row(1, [0], "para", bodies=[text("Intro with "), link("a link", "Target"), text(".")]),
    row(1, [1], "section", heading="First part"),
    row(1, [1, 0], "para", bodies=[text("One")]),
    row(1, [1, 1], "section", heading="Inner"),
    row(1, [1, 1, 0], "list", level=1, bodies=[text("item one")]),
    row(1, [1, 1, 1], "list", level=2, bodies=[link("item two", "Two", "Sec")]),
    row(1, [1, 1, 2], "section", heading="Deep"),
    row(1, [1, 1, 2, 0], "para", bodies=[text("Bottom")]),
    row(1, [1, 2], "image", url="http://x/i.png"),
    row(1, [1, 2, 0], "para", bodies=[text("Caption A")]),
    row(1, [1, 2, 1], "para", bodies=[text("Caption B")]),
    row(1, [2], "section", heading="Empty"),
    row(2, [0], "section", heading="Alone"),
]


@pytest.fixture(scope="module")
def elements(spark):
    # several partitions, reversed: nothing may rely on the order of rows
    return spark.createDataFrame(ROWS[::-1], FIELDS).repartition(5)


def test_page_text_joins_childless_elements(elements):
    got = dict(ops.gather_pages(elements).select("page_id", P.text_of_page(F.col("elements"))).collect())
    assert got[1] == "Intro with a link.\nOne\nitem one\nitem two\nBottom\nCaption A\nCaption B\n"
    assert got[2] == ""


def test_page_markup(elements):
    got = dict(ops.gather_pages(elements).select("page_id", P.markup_of_page(F.col("elements"))).collect())
    assert got[1] == (
        "Intro with  [a link](Target) ."
        "\n\n= First part =\n\nOne"
        "\n== Inner ==\n\n* item one\n** [item two](Two)\n"
        "\n=== Deep ===\n\nBottom"
        "![http://x/i.png]. Caption: Caption ACaption B"
        "\n\n= Empty =\n\n"
    )
    assert got[2] == "\n= Alone =\n\n"


def test_outline_is_the_top_level_sections(elements):
    got = {(r.page_id, r.heading) for r in ops.outline(elements).collect()}
    assert got == {(1, "First part"), (1, "Empty"), (2, "Alone")}


def test_heading_paths_at_every_depth(elements):
    got = {
        (r.page_id, tuple(r.path)): [h.heading for h in r.headings] for r in ops.heading_paths(elements).collect()
    }
    assert len(got) == len(ROWS)
    assert got[1, (0,)] == []
    assert got[1, (1, 1, 2, 0)] == ["First part", "Inner", "Deep"]
    assert got[1, (1, 1, 2)] == ["First part", "Inner"]
    # the image is no section
    assert got[1, (1, 2, 1)] == ["First part"]


def test_child_at(elements):
    got = ops.child_at(elements, 1, under=[1, 1]).collect()
    assert [(r.page_id, r.path) for r in got] == [(1, [1, 1, 1])]


def test_markup_to_elements(spark):
    html = (
        "<html><head><title>t</title><script>var a='</p><p>no</p>';</script></head><body>"
        "<nav><ul><li class='x'><a href=\"/A#one\">A &amp; B</a></li><li><a href=\"/C#1#2\">C</a></li></ul></nav>"
        "<div>ad</div><h1>Head</h1><p>open <b>bold</b><p>x &lt;y&gt; <a href=\"/D\">d</a> z</p>"
        "<!-- <p>hidden</p> --><h1>Last</h1></article><footer><p>f</p></footer></body></html>"
    )
    df = spark.createDataFrame([(1, html), (2, "")], "page_id bigint, html string")
    rows = ops.element_rows(ops.page_arrays(df, "html")).orderBy("path").collect()
    assert [(r.path, r.kind, r.heading, "".join(b.text for b in r.bodies)) for r in rows] == [
        ([0], "list", None, "A & B"),
        ([1], "list", None, "C"),
        ([2], "section", "Head", ""),
        ([2, 0], "para", None, "open bold"),
        ([2, 1], "para", None, "x <y> d z"),
        ([3], "section", "Last", ""),
    ]
    links = [b for r in rows for b in r.bodies if b.kind == "link"]
    assert [(b.page, b.page_id, b.link_section) for b in links] == [("A", "/A", "one"), ("C", "/C", None), ("D", "/D", None)]
    assert [h.heading for h in rows[3].headings] == ["Head"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(
        [("one", "id:One", "One"), ("item two", "id:Two", "Two")], "surface string, entity_id string, entity_name string"
    )


def with_headings(elements):
    return ops.gather_pages(elements.join(ops.heading_paths(elements), ["page_id", "path"]))


def test_synthetic_pages_keep_the_text_and_the_tree(elements, names):
    pages = with_headings(elements)
    new = ops.synthetic_pages(pages, names, max_words=2)
    old_rows = {(r.page_id, tuple(e.path)): e for r in pages.collect() for e in r.elements}
    for r in new.collect():
        for e in r.elements:
            before = old_rows.pop((r.page_id, tuple(e.path)))
            assert "".join(b.text for b in e.bodies) == "".join(b.text for b in before.bodies)
            assert (e.kind, e.heading, e.para_id, e.image_url, e.list_level) == (
                before.kind, before.heading, before.para_id, before.image_url, before.list_level,
            )
        paragraphs = {tuple(p.path): [(b.kind, b.text, b.page_id) for b in p.bodies] for p in r.paragraphs}
        if r.page_id == 2:
            assert paragraphs == {}
        else:
            assert list(paragraphs) == [(0,), (1, 0), (1, 1, 0), (1, 1, 1), (1, 1, 2, 0), (1, 2, 0), (1, 2, 1)]
            assert paragraphs[1, 1, 0] == [("text", "item ", None), ("link", "one", "id:One")]
            assert paragraphs[1, 1, 1] == [("link", "item two", "id:Two")]
    assert not old_rows
    assert STUB_ID == "STUB_PAGE_ID"


def test_unknown_kind_fails(spark, names):
    bad = spark.createDataFrame([row(1, [0], "video", bodies=[text("x")])], FIELDS)
    with pytest.raises(Exception, match="not an element kind: video"):
        ops.synthetic_pages(ops.gather_pages(bad), names).collect()


def test_document_messages(elements, names):
    pages = ops.synthetic_pages(with_headings(elements), names, max_words=2).withColumn("name", F.lit("n"))
    got = {r.doc_id: r for r in ops.document_messages(pages, "page_id", "name").collect()}
    contents = {c.id: c for c in got["1"].document_contents}
    deep = contents["p1-1.1.2.0"]
    assert deep.section_heading_name == "Deep"
    assert deep.parent_section_heading_names == ["First part", "Inner", "Deep"]
    assert contents["1.2"].objects_type == "IMAGE" and contents["1.2"].content_urls == ["http://x/i.png"]
    assert contents["p1-1.1.0"].objects_type == "LIST"
    (k,) = contents["p1-1.1.0"].entity_links
    assert (k.anchor_text, k.anchor_text_location.start, k.anchor_text_location.end) == ("one", 5, 8)
    for c in contents.values():
        for k in c.entity_links:
            assert c.text[k.anchor_text_location.start : k.anchor_text_location.end] == k.anchor_text
    totals = {(t.entity_id, a.anchor_text): a.frequency for t in got["1"].entity_link_totals for a in t.anchor_text_frequency}
    assert totals == {("id:One", "One"): 1, ("id:One", "one"): 1, ("id:Two", "item two"): 1}
    assert len(got["1"].entity_link_totals) == 2
    assert got["2"].document_contents == [] and got["2"].entity_link_totals == []


def test_page_types(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 1, None), (3, 2, "x"), (4, 3, "T")], "page_id int, tag int, target string")
    got = df.select("page_id", ops.page_type(F.col("tag")), ops.redirect_target(F.col("tag"), F.col("target"))).collect()
    assert [tuple(r) for r in got] == [
        (1, "Article", None), (2, "Category", None), (3, "Disambiguation", None), (4, "Redirect", "T"),
    ]
    with pytest.raises(Exception, match="not a page type: 9"):
        df.select(ops.page_type(F.lit(9))).collect()


def test_metadata(spark):
    tags = [(1, t, [f"a{t}", f"b{t}"], []) for t in range(6)] + [(1, 7, [], [("x", 3), ("y", 1)])]
    tags += [(2, t, [], []) for t in range(8)]
    tags += [(3, 6, ["old", "older"], []), (3, 7, [], [])]
    df = spark.createDataFrame(tags, "page_id int, tag int, names array<string>, pairs array<struct<anchor:string,freq:int>>")
    meta = ops.page_metadata(df)
    got = {r.page_id: r for r in meta.select("*", ops.metadata_line().alias("line")).collect()}
    assert got[1].redirect_names == ["a0", "b0"] and got[1].inlink_ids == ["a5", "b5"]
    assert [tuple(a) for a in got[1].inlink_anchors] == [("x", 3), ("y", 1)]
    assert got[1].line == (
        " redirected = a0, b0 \n disambiguated = a1, b1 \n categories = a3, b3 \n inlinks = a5, b5 \n inlinkAnchors = x: 3, y: 1\n"
    )
    assert all(got[2][c] is None for c in meta.columns if c != "page_id")
    assert got[2].line == " \n \n \n \n\n"
    assert [tuple(a) for a in got[3].inlink_anchors] == [("old", 1), ("older", 1)]
