"""Page trees, mentions and document messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.functions import pages as P
from quillwork.operators import mentions as mention_ops
from quillwork.operators import pages as page_ops
from quillwork.registry import query
from quillwork.sources import writers
from quillwork.sources.storage import durable
from quillwork.sources.tables import spread, table

_ELEMENTS = r"""
cleaned AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '[\x01-\x04]', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
           '(?s)<(script|style|footer)[ >].*?</(script|style|footer)>', '', 'g'),
           '<(h1|p|li)( [^>]*)?>', chr(1) || '\1' || chr(2), 'g') AS marked
  FROM pages),
sections AS (
  SELECT page_id, unnest(string_split(marked, chr(1) || 'h1' || chr(2))) AS section,
         generate_subscripts(string_split(marked, chr(1) || 'h1' || chr(2)), 1) AS s FROM cleaned),
parts AS (
  SELECT page_id, s, unnest(string_split(section, chr(1))) AS part,
         generate_subscripts(string_split(section, chr(1)), 1) AS j FROM sections),
tops AS (SELECT page_id, count(*) FILTER (WHERE s = 1 AND j > 1) AS k FROM parts GROUP BY page_id),
flats AS (
  SELECT page_id, s, j, k, starts_with(part, 'li' || chr(2)) AS is_item,
         regexp_replace(
           replace(replace(replace(replace(replace(replace(replace(replace(
             regexp_replace(regexp_replace(regexp_replace(
               string_split_regex(CASE WHEN s > 1 AND j = 1 THEN part ELSE string_split(part, chr(2))[2] END,
                                  '</(h1|li|nav|article)>')[1],
               '(?s)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>', chr(3) || '\1' || chr(4) || '\2' || chr(3), 'g'),
               '<br */?>', chr(10), 'g'), '<[^>]*>', '', 'g'),
             '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '),
             '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
           '^\s+|\s+$', '', 'g') AS flat
  FROM parts JOIN tops USING (page_id) WHERE s > 1 OR j > 1),
elements AS (
  SELECT page_id, flat,
         CASE WHEN s = 1 THEN CAST(j - 2 AS VARCHAR) WHEN j = 1 THEN CAST(k + s - 2 AS VARCHAR)
              ELSE (k + s - 2) || '.' || (j - 2) END AS path,
         CASE WHEN s = 1 THEN j - 2 ELSE k + s - 2 END AS top, CASE WHEN s = 1 OR j = 1 THEN -1 ELSE j - 2 END AS sub,
         CAST(CASE WHEN s > 1 AND j > 1 THEN 2 ELSE 1 END AS INTEGER) AS depth,
         CASE WHEN s > 1 AND j = 1 THEN 'section' WHEN is_item THEN 'list' ELSE 'para' END AS kind,
         replace(regexp_replace(flat, '\x03[^\x03\x04]*\x04', '', 'g'), chr(3), '') AS text
  FROM flats)"""

_LINKS = (
    _ELEMENTS
    + r""",
pieces AS (
  SELECT page_id, path, unnest(string_split(flat, chr(3))) AS piece,
         generate_subscripts(string_split(flat, chr(3)), 1) AS i
  FROM elements WHERE kind <> 'section'),
bodies AS (
  SELECT page_id, path, i, CASE WHEN i % 2 = 0 THEN 'link' ELSE 'text' END AS kind,
         CASE WHEN i % 2 = 0 THEN string_split(piece, chr(4))[2] ELSE piece END AS text,
         CASE WHEN i % 2 = 0 THEN string_split(string_split(piece, chr(4))[1], '#')[1] END AS target_id,
         CASE WHEN i % 2 = 0 AND len(string_split(string_split(piece, chr(4))[1], '#')) = 2
              THEN nullif(string_split(string_split(piece, chr(4))[1], '#')[2], '') END AS link_section
  FROM pieces WHERE i % 2 = 0 OR piece <> ''),
links AS (
  SELECT page_id AS from_page, text AS anchor_text, target_id,
         regexp_extract(target_id, '([^/]*)$', 1) AS page FROM bodies WHERE kind = 'link')"""
)

_NAMES = (
    _LINKS
    + r""",
anchor_counts AS (
  SELECT regexp_replace(lower(anchor_text), '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g') AS surface,
         target_id AS entity_id, page AS entity_name, count(*) AS n FROM links GROUP BY 1, 2, 3),
names AS (
  SELECT surface, entity_id, entity_name, n AS links FROM anchor_counts WHERE surface <> ''
  QUALIFY row_number() OVER (PARTITION BY surface ORDER BY n DESC, entity_id) = 1)"""
)



def _with_names_merged(source: str, target: str, keys: str) -> str:
    """CTEs that put the words of each name of up to three words together: longest first, left to right.

    Names that overlap others form islands, and only these are walked one after the other.
    """
    p = target
    same = " AND ".join(f"t.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    return f""",
{p}_runs AS (
  SELECT *, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third,
         word || lead(gap, 1) OVER w || lead(word, 1) OVER w AS two,
         word || lead(gap, 1) OVER w || lead(word, 1) OVER w || lead(gap, 2) OVER w || lead(word, 2) OVER w AS three
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
{p}_names AS (
  SELECT {keys}, i, CASE WHEN c.surface IS NOT NULL THEN 3 WHEN b.surface IS NOT NULL THEN 2 ELSE 1 END AS n
  FROM {p}_runs r LEFT JOIN names a ON a.surface = lower(word)
       LEFT JOIN names b ON b.surface = lower(two) AND second <> '' LEFT JOIN names c ON c.surface = lower(three) AND third <> ''
  WHERE word <> '' AND coalesce(a.surface, b.surface, c.surface) IS NOT NULL),
{p}_islands AS (
  SELECT *, sum(CASE WHEN i >= coalesce(reach, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS island
  FROM (SELECT *, max(i + n) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM {p}_names)),
{p}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys}, island ORDER BY i) AS k FROM {p}_islands),
{p}_walk AS (
  SELECT {keys}, island, k, i, n, true AS taken, i + n AS free FROM {p}_ranked WHERE k = 1
  UNION ALL
  SELECT {keys}, island, r.k, r.i, r.n, r.i >= w.free, CASE WHEN r.i >= w.free THEN r.i + r.n ELSE w.free END
  FROM {p}_walk w JOIN {p}_ranked r USING ({keys}, island) WHERE r.k = w.k + 1),
{p}_long AS (SELECT * FROM {p}_walk WHERE taken AND n > 1),
{p} AS (
  SELECT t.* EXCLUDE (word, second, third, two, three), CASE v.n WHEN 3 THEN three WHEN 2 THEN two ELSE word END AS word
  FROM {p}_runs t LEFT JOIN {p}_long v ON {same} AND t.i = v.i
  WHERE NOT EXISTS (SELECT 1 FROM {p}_long v WHERE {same} AND t.i > v.i AND t.i < v.i + v.n))"""


_TOKENS = (
    _NAMES
    + r""",
found_tokens AS (
  SELECT doc_id,
         unnest(regexp_extract_all(text, '([^\p{L}\p{M}\p{N}]*)([\p{L}\p{M}\p{N}]*)', 1)) AS gap,
         unnest(regexp_extract_all(text, '([^\p{L}\p{M}\p{N}]*)([\p{L}\p{M}\p{N}]*)', 2)) AS word,
         generate_subscripts(regexp_extract_all(text, '([^\p{L}\p{M}\p{N}]*)([\p{L}\p{M}\p{N}]*)', 2), 1) AS i
  FROM documents)"""
    + _with_names_merged("found_tokens", "tokens", "doc_id")
    + r""",
placed AS (
  SELECT t.*, n.surface IS NOT NULL AS hit, n.entity_id, n.entity_name, n.links,
         sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS end_at
  FROM tokens t LEFT JOIN names n ON n.surface = lower(t.word) AND t.word <> '')"""
)

_PARAGRAPHS = (
    _NAMES
    + r""",
found_etokens AS (
  SELECT page_id, path,
         unnest(regexp_extract_all(text, '([^\p{L}\p{M}\p{N}]*)([\p{L}\p{M}\p{N}]*)', 1)) AS gap,
         unnest(regexp_extract_all(text, '([^\p{L}\p{M}\p{N}]*)([\p{L}\p{M}\p{N}]*)', 2)) AS word,
         generate_subscripts(regexp_extract_all(text, '([^\p{L}\p{M}\p{N}]*)([\p{L}\p{M}\p{N}]*)', 2), 1) AS i
  FROM elements WHERE kind <> 'section')"""
    + _with_names_merged("found_etokens", "etokens", "page_id, path")
    + r""",
eplaced AS (
  SELECT t.*, n.surface IS NOT NULL AS hit, n.entity_id, n.entity_name,
         sum(length(gap) + length(word)) OVER (PARTITION BY page_id, path ORDER BY i) AS end_at
  FROM etokens t LEFT JOIN names n ON n.surface = lower(t.word) AND t.word <> ''),
cut AS (
  SELECT page_id, path, count(*) FILTER (WHERE hit) AS n_links,
         string_agg(gap || CASE WHEN hit THEN '[' || word || '](' || entity_id || ')' ELSE word END, '' ORDER BY i) AS linked,
         string_agg(word || '@' || (end_at - length(word)) || '-' || end_at || '>' || entity_id, ';' ORDER BY i)
           FILTER (WHERE hit) AS links
  FROM eplaced GROUP BY page_id, path)"""
)


def _pages(spark, sf):
    pages = spread(table(spark, sf, "pages"), "page_id")
    return page_ops.page_arrays(pages, "html")


def _elements(spark, sf):
    return page_ops.element_rows(_pages(spark, sf))


def _links(spark, sf):
    return page_ops.link_rows(page_ops.body_rows(_elements(spark, sf)))


def _names(spark, sf):
    # used several times by every caller, so it is computed once
    return durable(mention_ops.entity_dictionary(_links(spark, sf)))


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _dotted(path):
    return F.array_join(path.cast("array<string>"), ".")


@query(
    "page_elements",
    f"""WITH {_ELEMENTS}
        SELECT page_id, path, depth, kind, CASE WHEN kind = 'section' THEN text END AS heading,
               CASE WHEN kind = 'list' THEN 1 END AS list_level,
               CASE WHEN kind = 'section' THEN '' ELSE text END AS text FROM elements""",
)
def page_elements(spark, sf):
    return _elements(spark, sf).select(
        "page_id",
        _dotted(F.col("path")).alias("path"),
        "depth",
        "kind",
        "heading",
        "list_level",
        P.body_text(F.col("bodies")).alias("text"),
    )


@query(
    "page_links",
    f"""WITH {_LINKS}
        SELECT page_id, path, CAST(row_number() OVER (PARTITION BY page_id, path ORDER BY i) - 1 AS INTEGER) AS position,
               kind, text, regexp_extract(target_id, '([^/]*)$', 1) AS page, target_id, link_section FROM bodies""",
)
def page_links(spark, sf):
    bodies = page_ops.body_rows(_elements(spark, sf))
    return bodies.withColumn("path", _dotted(F.col("path")))


@query(
    "page_text",
    f"""WITH {_ELEMENTS}
        SELECT page_id, string_agg(CASE WHEN kind = 'section' THEN '' ELSE text END, chr(10) ORDER BY top, sub) AS text
        FROM elements e
        WHERE kind <> 'section' OR NOT EXISTS (SELECT 1 FROM elements c
                                               WHERE c.page_id = e.page_id AND c.top = e.top AND c.sub >= 0)
        GROUP BY page_id""",
)
def page_text(spark, sf):
    return _pages(spark, sf).select("page_id", P.text_of_page(F.col("elements")).alias("text"))


@query(
    "page_markup",
    f"""WITH {_LINKS},
        inline_text AS (
          SELECT page_id, path, string_agg(CASE WHEN kind = 'link' THEN '[' || text || '](' ||
                   regexp_extract(target_id, '([^/]*)$', 1) || ')' ELSE text END, ' ' ORDER BY i) AS t
          FROM bodies GROUP BY page_id, path)
        SELECT page_id, string_agg(
                 CASE WHEN depth = 1 AND top > 0 THEN chr(10) ELSE '' END ||
                 CASE WHEN kind = 'section' THEN chr(10) || '= ' || text || ' =' || chr(10) || chr(10)
                      WHEN kind = 'list' THEN '* ' || coalesce(t, '') || chr(10)
                      ELSE coalesce(t, '') END, '' ORDER BY top, sub) AS markup
        FROM elements LEFT JOIN inline_text USING (page_id, path) GROUP BY page_id""",
)
def page_markup(spark, sf):
    return _pages(spark, sf).select("page_id", P.markup_of_page(F.col("elements")).alias("markup"))


@query(
    "page_outline",
    f"""WITH {_ELEMENTS}
        SELECT page_id, path, text AS heading, replace(text, ' ', '%20') AS heading_id
        FROM elements WHERE kind = 'section' AND depth = 1""",
)
def page_outline(spark, sf):
    return page_ops.outline(_elements(spark, sf)).withColumn("path", _dotted(F.col("path")))


@query(
    "heading_paths",
    f"""WITH {_ELEMENTS}
        SELECT e.page_id, e.path, CASE WHEN e.sub >= 0 THEN 1 ELSE 0 END AS n_headings,
               coalesce(s.text, '') AS headings, coalesce(replace(s.text, ' ', '%20'), '') AS heading_ids
        FROM elements e LEFT JOIN elements s
          ON s.page_id = e.page_id AND s.kind = 'section' AND e.sub >= 0 AND s.top = e.top""",
)
def heading_paths(spark, sf):
    paths = page_ops.heading_paths(_elements(spark, sf))
    return paths.select(
        "page_id",
        _dotted(F.col("path")).alias("path"),
        F.size("headings").alias("n_headings"),
        F.array_join(F.transform("headings", lambda h: h["heading"]), " / ").alias("headings"),
        F.array_join(F.transform("headings", lambda h: h["heading_id"]), "/").alias("heading_ids"),
    )


@query(
    "child_at",
    f"""WITH {_ELEMENTS} SELECT page_id, path, kind, text FROM elements WHERE sub = 1""",
)
def child_at(spark, sf):
    second = page_ops.child_at(_elements(spark, sf), 1)
    return second.select(
        "page_id", _dotted(F.col("path")).alias("path"), "kind", P.body_text(F.col("bodies")).alias("text")
    )


@query(
    "mention_spans",
    f"""WITH RECURSIVE {_TOKENS}
        SELECT doc_id, CAST(end_at - length(word) AS INTEGER) AS "start", CAST(end_at AS INTEGER) AS "end",
               word AS mention
        FROM placed WHERE hit""",
)
def mention_spans(spark, sf):
    return mention_ops.mention_rows(_documents(spark, sf), "doc_id", "text", _names(spark, sf))


@query(
    "split_at_mentions",
    f"""WITH RECURSIVE {_TOKENS},
        grouped AS (
          SELECT *, coalesce(sum(CAST(hit AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM placed),
        both_kinds AS (
          SELECT doc_id, g * 2 AS o, 'text' AS kind,
                 string_agg(CASE WHEN hit THEN gap ELSE gap || word END, '' ORDER BY i) AS text,
                 max(end_at) - coalesce(max(length(word)) FILTER (WHERE hit), 0) AS e
          FROM grouped GROUP BY doc_id, g
          UNION ALL SELECT doc_id, g * 2 + 1, 'link', word, end_at FROM grouped WHERE hit)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS position, kind, text,
               CAST(e - length(text) AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end"
        FROM both_kinds WHERE text <> ''""",
)
def split_at_mentions(spark, sf):
    return mention_ops.piece_rows(_documents(spark, sf), "doc_id", "text", _names(spark, sf))


@query(
    "link_entities",
    f"""WITH RECURSIVE {_TOKENS}
        SELECT doc_id, CAST(end_at - length(word) AS INTEGER) AS "start", CAST(end_at AS INTEGER) AS "end",
               word AS mention, entity_id, entity_name
        FROM placed WHERE hit""",
)
def link_entities(spark, sf):
    return mention_ops.mention_rows(_documents(spark, sf), "doc_id", "text", _names(spark, sf), entities=True)


def _synthetic(spark, sf):
    return page_ops.synthetic_pages(_pages(spark, sf), _names(spark, sf))


@query("synthetic_page")
def synthetic_page(spark, sf):
    return _synthetic(spark, sf).select("page_id", "url", "elements")


@query(
    "synthetic_paragraphs",
    f"""WITH RECURSIVE {_PARAGRAPHS}
        SELECT e.page_id, e.path, md5(e.text) AS para_id, CAST(coalesce(c.n_links, 0) AS INTEGER) AS n_links,
               coalesce(c.linked, '') AS linked
        FROM elements e LEFT JOIN cut c USING (page_id, path) WHERE e.kind <> 'section'""",
)
def synthetic_paragraphs(spark, sf):
    paragraphs = page_ops.unnest(_synthetic(spark, sf), "page_id", "paragraphs").where(F.col("path").isNotNull())
    linked = F.transform(
        "bodies",
        lambda b: F.when(b["kind"] == "link", F.concat(F.lit("["), b["text"], F.lit("]("), b["page_id"], F.lit(")")))
        .otherwise(b["text"]),
    )
    return paragraphs.select(
        "page_id",
        _dotted(F.col("path")).alias("path"),
        "para_id",
        F.size(F.filter("bodies", lambda b: b["kind"] == "link")).alias("n_links"),
        F.array_join(linked, "").alias("linked"),
    )


@query(
    "page_type_decode",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Article' WHEN 1 THEN 'Category'
                                        WHEN 2 THEN 'Disambiguation' ELSE 'Redirect' END AS page_type,
              CASE WHEN page_id % 4 = 3 THEN url END AS redirect_target
       FROM pages""",
)
def page_type_decode(spark, sf):
    tag = F.col("page_id") % 4
    return table(spark, sf, "pages").select(
        "page_id",
        page_ops.page_type(tag).alias("page_type"),
        page_ops.redirect_target(tag, F.col("url")).alias("redirect_target"),
    )


@query(
    "page_metadata",
    r"""WITH m AS (
          SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS host, url,
                 regexp_extract_all(html, 'href="([^"]*)"', 1) AS ids,
                 regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS anchors FROM pages)
        SELECT page_id, url AS redirect_names, host AS category_names,
               nullif(array_to_string(ids, ','), '') AS inlink_ids, len(anchors) AS n_anchors,
               ' redirected = ' || url || ' ' || chr(10) || ' ' || chr(10) || ' categories = ' || host || ' ' || chr(10)
               || CASE WHEN len(ids) = 0 THEN '' ELSE ' inlinks = ' || array_to_string(ids, ', ') END || ' ' || chr(10)
               || CASE WHEN len(anchors) = 0 THEN ''
                       ELSE ' inlinkAnchors = ' || array_to_string([a || ': 1' for a in anchors], ', ') END
               || chr(10) AS line
        FROM m""",
)
def page_metadata(spark, sf):
    pages = table(spark, sf, "pages")
    empty = F.array().cast("array<string>")
    no_pairs = F.array().cast("array<struct<anchor:string,freq:int>>")

    def tag(number, names):
        return F.struct(F.lit(number).alias("tag"), names.alias("names"), no_pairs.alias("pairs"))

    tagged = pages.select(
        "page_id",
        F.inline(
            F.array(
                tag(0, F.array("url")),
                tag(1, empty),
                tag(3, F.array(F.regexp_extract("url", "^(https?://[^/]*)", 1))),
                tag(5, F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)),
                tag(6, F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1)),
            )
        ),
    )
    decoded = page_ops.page_metadata(tagged)
    return decoded.select(
        "page_id",
        F.array_join("redirect_names", ",").alias("redirect_names"),
        F.array_join("category_names", ",").alias("category_names"),
        F.array_join("inlink_ids", ",").alias("inlink_ids"),
        F.coalesce(F.array_size("inlink_anchors"), F.lit(0)).cast("bigint").alias("n_anchors"),
        page_ops.metadata_line().alias("line"),
    )


@query(
    "inlink_totals",
    f"""WITH {_LINKS}
        SELECT target_id AS entity_id, page AS entity_name, anchor_text, count(*) AS frequency
        FROM links GROUP BY 1, 2, 3""",
)
def inlink_totals(spark, sf):
    return page_ops.inlink_totals(_links(spark, sf))


@query(
    "inlink_pages",
    f"""WITH {_LINKS} SELECT DISTINCT target_id AS entity_id, from_page AS page_id FROM links""",
)
def inlink_pages(spark, sf):
    return page_ops.inlink_pages(_links(spark, sf))


@query(
    "doc_message",
    f"""WITH RECURSIVE {_PARAGRAPHS},
        contents AS (
          SELECT e.page_id, count(*) AS n, sum(coalesce(c.n_links, 0)) AS n_links,
                 string_agg(CASE kind WHEN 'list' THEN 'LIST' ELSE 'PARAGRAPH' END || '|' || coalesce(s.heading, '') || '|'
                            || e.text || '|' || coalesce(c.links, ''), chr(10) || chr(10) ORDER BY e.top, e.sub) AS contents
          FROM elements e LEFT JOIN cut c USING (page_id, path)
               LEFT JOIN (SELECT page_id, top, text AS heading FROM elements WHERE kind = 'section') s
                 ON s.page_id = e.page_id AND s.top = e.top AND e.sub >= 0
          WHERE e.kind <> 'section' GROUP BY e.page_id),
        totals AS (
          SELECT page_id, string_agg(entity_id || '=' || word || ':' || n, ',' ORDER BY entity_id, entity_name, word) AS totals
          FROM (SELECT page_id, entity_id, entity_name, word, count(*) AS n FROM eplaced WHERE hit GROUP BY 1, 2, 3, 4)
          GROUP BY page_id)
        SELECT CAST(page_id AS VARCHAR) AS doc_id, url AS doc_name, CAST(coalesce(n, 0) AS INTEGER) AS n_contents,
               coalesce(contents, '') AS contents, coalesce(totals, '') AS link_totals
        FROM pages LEFT JOIN contents USING (page_id) LEFT JOIN totals USING (page_id)""",
)
def doc_message(spark, sf):
    messages = page_ops.document_messages(_synthetic(spark, sf), "page_id", "url")
    stored = spark.read.parquet(writers.write_fresh(messages, "document-messages"))

    def link(k):
        at = k["anchor_text_location"]
        span = F.concat(at["start"].cast("string"), F.lit("-"), at["end"].cast("string"))
        return F.concat(k["anchor_text"], F.lit("@"), span, F.lit(">"), k["entity_id"])

    def content(c):
        heading = F.coalesce(c["section_heading_name"], F.lit(""))
        links = F.array_join(F.transform(c["entity_links"], link), ";")
        return F.concat_ws("|", c["objects_type"], heading, c["text"], links)

    def total(t):
        return F.transform(
            t["anchor_text_frequency"],
            lambda a: F.concat(t["entity_id"], F.lit("="), a["anchor_text"], F.lit(":"), a["frequency"].cast("string")),
        )

    # the stored records are nested; they are flattened here to be compared
    return stored.select(
        "doc_id",
        "doc_name",
        F.size("document_contents").alias("n_contents"),
        F.array_join(F.transform("document_contents", content), "\n\n").alias("contents"),
        F.array_join(F.flatten(F.transform("entity_link_totals", total)), ",").alias("link_totals"),
    )
