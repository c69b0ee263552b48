"""Licence scans: ordered signature rules behind a keyword prefilter, settled by priority and containment.

Everything is a native expression inside the text's own row: no shuffle, no Python. A text becomes its
lower-case words with one blank on either side of each, so two neighbouring words stand two blanks apart
and a rule's pattern needs no look-around; the place of a match in words is half the blanks before it.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.arrays import let, prefix_sums, scan
from quillwork.llm.registry import llm_query
from quillwork.llm.signatures import RULES, WEIGHTS, Rule
from quillwork.sources.tables import table

# The phrases whose places are always reported, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_HIT = "struct<start:int,back:int,priority:int,rule:int,label:string>"


def spaced(pattern: str) -> str:
    """A pattern over words with one blank between them, as one over words with a blank on either side."""
    wide = re.sub(r" (\?)?", lambda m: "(?:  )?" if m[1] else "  ", pattern.replace(r"\S", "[^ ]"))
    return f" {wide} "


def keywords_of(rule: Rule) -> list[str]:
    """The spellings of a rule's keyword, as they stand in a spaced text."""
    forms = [rule.keyword]
    while any("[cs]" in f for f in forms):
        forms = [f.replace("[cs]", c, 1) for f in forms for c in "cs"]
    return [f" {f.replace(' ', '  ')} " for f in forms]


def anchors_of(forms: list[list[str]]) -> list[list[str]]:
    """For each rule's keyword spellings the words that give them away, one a spelling; few different ones in all.

    The keyword is looked for only in texts that have the word. The word that most spellings share is taken
    first, then the one that most of the rest share; words of up to four letters, which are in most
    texts, stand in only for keywords that have no other.
    """
    words = {f: [w for w in f.split() if len(w) > 4] or f.split() for rule in forms for f in rule}
    chosen: dict[str, str] = {}
    while left := [f for f in words if f not in chosen]:
        votes = Counter(w for f in left for w in set(words[f]))
        best = max(votes, key=lambda w: (votes[w], len(w), w))
        chosen |= {f: best for f in left if best in words[f]}
    return [sorted({chosen[f] for f in rule}) for rule in forms]


def spaced_text(text: Column) -> Column:
    """``text`` as words with a blank on either side of each, in their own case; null is the empty text."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _BETWEEN, "  ")


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(text: Column, pattern: Column) -> Column:
    """``start, end`` in words, end exclusive, of a pattern's matches in a spaced text, from left to right.

    Matches are marked and the text is split at the marks, in one pass: what is found and what stands
    between alternate.
    """

    def measured(pieces: Column) -> Column:
        ends = prefix_sums(F.transform(pieces, blanks))
        return let(ends, lambda b: F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
            lambda i: F.struct((F.get(b, i - 1) / 2).cast("int").alias("start"), (F.get(b, i) / 2).cast("int").alias("end")),
        ))

    none = F.array().cast("array<struct<start:int,end:int>>")
    marked = F.regexp_replace(text, pattern, F.lit("\x01$0\x01"))
    return let(F.split(marked, F.lit("\x01")), lambda m: F.when(F.size(m) > 1, measured(m)).otherwise(none))


_RULE = "array<struct<rule:int,label:string,priority:int,anchors:array<string>,keywords:array<string>,pattern:string>>"


def _rule_table(rules: list[Rule]) -> Column:
    """The rules as one constant, read from one literal: thousands of literals would slow the planner down."""
    forms = [keywords_of(r) for r in rules]
    rows = [
        {"rule": i, "label": r.label, "priority": r.priority, "anchors": a, "keywords": k, "pattern": spaced(r.pattern)}
        for i, (r, k, a) in enumerate(zip(rules, forms, anchors_of(forms)))
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULE)


def _hits(present: Column, text: Column, rules: list[Rule]) -> Column:
    """Matches of all rules whose keyword is there, by start, the longer first, then by priority and rule."""

    def gated(t: Column) -> Column:
        tried = F.filter(
            _rule_table(rules),
            lambda r: F.arrays_overlap(present, r["anchors"]) & F.exists(r["keywords"], lambda k: F.contains(t, k)),
        )
        return F.flatten(F.transform(tried, lambda r: F.transform(places(t, r["pattern"]), lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), r["priority"].alias("priority"),
            r["rule"].alias("rule"), r["label"].alias("label"),
        ))))

    return F.array_sort(let(text, gated))


def _settled(hits: Column) -> Column:
    """Hits that no hit of the same or a higher priority contains; the longer, then the earlier rule counts as higher.

    In the order of ``hits`` whatever contains a hit comes before it, so one walk with the farthest end
    seen so far of each priority decides.
    """
    levels = sorted(WEIGHTS)
    far = F.struct(*[F.lit(-1).alias(f"p{p}") for p in levels])

    def step(carry: Column, hit: Column):
        end = -hit["back"]
        after = F.struct(*[
            F.when(hit["priority"] == p, F.greatest(carry[f"p{p}"], end)).otherwise(carry[f"p{p}"]).alias(f"p{p}") for p in levels
        ])
        covered = F.greatest(F.lit(-1), *[F.when(hit["priority"] >= p, carry[f"p{p}"]).otherwise(-1) for p in levels])
        return after, hit, covered < end

    kept = scan(hits, far, _HIT, step)
    return F.transform(kept, lambda h: F.struct(
        h["label"].alias("label"), h["rule"].alias("rule"), h["priority"].alias("priority"),
        h["start"].alias("start"), (-h["back"]).alias("end"),
    ))


def detect(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, phrases: dict[str, str] = BASE) -> DataFrame:
    """``docs`` with ``words`` (long), ``places`` of phrases and ``detections`` of rules, both in words, end exclusive.

    ``places``: label, start, end wherever the words of a phrase stand consecutively; nothing settles them.
    ``detections``: label, rule number, priority, start, end of the hits that stay. A null or empty text,
    or one without words, has none. Rows keep their number, repeated rows their own results; input columns
    of these three names are replaced. Matches of one rule do not overlap each other; ties go by the
    order of ``rules``.
    """
    result = ("words", "places", "detections")
    own = [c for c in docs.columns if c not in result]
    every = [keywords_of(r) for r in rules] + [[spaced(p)] for p in phrases]
    anchors = F.split(F.lit(" ".join(sorted({w for rule in anchors_of(every) for w in rule}))), " ")
    one_of = F.from_json(F.lit(json.dumps([{"words": spaced(p), "label": x} for p, x in phrases.items()])), "array<struct<words:string,label:string>>")

    def looked_at(words: Column) -> Column:
        return F.struct(
            (F.size(words) - 2).alias("words"),  # the text stands between blanks, so the first and the last piece are empty
            F.array_intersect(words, anchors).alias("anchors"),
        )

    def placed(t: Column) -> Column:
        met = F.filter(one_of, lambda p: F.contains(t, p["words"]))
        return F.flatten(F.transform(met, lambda p: F.transform(
            places(t, p["words"]), lambda s: F.struct(p["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))
        )))

    # letters beyond ASCII may change here too: the words stay as many, and they only choose which texts are looked at
    pieces = F.split(F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" ")), _BETWEEN)
    gated = docs.select(*own, F.col(text).alias("_licence_text"), let(pieces, looked_at).alias("_licence_gate"))
    gate = F.col("_licence_gate")
    spread = gated.withColumn("_licence_words", F.when(F.size(gate["anchors"]) > 0, F.translate(spaced_text(F.col("_licence_text")), _UPPER, _LOWER)))
    plain = F.col("_licence_words")
    none = F.array().cast("array<struct<label:string,rule:int,priority:int,start:int,end:int>>")
    nowhere = F.array().cast("array<struct<label:string,start:int,end:int>>")
    return spread.select(
        *own,
        gate["words"].cast("bigint").alias("words"),
        F.when(plain.isNotNull(), let(plain, placed)).otherwise(nowhere).alias("places"),
        F.when(plain.isNotNull(), let(_hits(gate["anchors"], plain, rules), _settled)).otherwise(none).alias("detections"),
    )


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ",\n    ".join(
        f"({i}, {quote(r.label)}, {r.priority}, {quote(spaced(r.pattern))}, [{', '.join(map(quote, keywords_of(r)))}])"
        for i, r in enumerate(RULES)
    )


_PHRASES = ", ".join(f"('{spaced(p)}', '{label}')" for p, label in BASE.items())
_WEIGHT = " ".join(f"WHEN {p} THEN {w}" for p, w in WEIGHTS.items())
SQL = f"""
WITH rules(rule, label, priority, pattern, keywords) AS (VALUES
    {_values()}),
base_phrases(phrase, label) AS (VALUES {_PHRASES}),
d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_replace(
        ' ' || translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') || ' ', '{_BETWEEN}', '  ', 'g') AS t
    FROM documents),
tried AS (
    SELECT r, rule, label, priority, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS gaps
    FROM d JOIN rules ON len(list_filter(keywords, lambda k: contains(t, k))) > 0
    UNION ALL
    SELECT r, -1, label, 0, regexp_extract_all(t, phrase), string_split_regex(t, phrase)
    FROM d JOIN base_phrases ON contains(t, phrase)),
numbered AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM tried WHERE len(found) > 0),
spans AS (
    SELECT r, rule, label, priority,
        len(regexp_replace(array_to_string(gaps[1:i], '') || array_to_string(found[1:i - 1], ''), '[^ ]', '', 'g')) // 2 AS s,
        len(regexp_replace(found[i], '[^ ]', '', 'g')) // 2 AS n
    FROM numbered),
hits AS (SELECT * FROM spans WHERE rule >= 0),
kept AS (
    SELECT DISTINCT r, label, priority FROM hits h WHERE NOT EXISTS (
        SELECT 1 FROM hits e WHERE e.r = h.r AND e.s <= h.s AND e.s + e.n >= h.s + h.n AND e.priority <= h.priority
            AND (e.priority < h.priority OR e.n > h.n OR e.rule < h.rule))),
base AS (
    SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM spans WHERE rule < 0 GROUP BY r),
named AS (
    SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT r, label FROM kept UNION SELECT r, label FROM spans WHERE rule < 0) GROUP BY r),
sure AS (SELECT r, max(CASE priority {_WEIGHT} ELSE 0.9 END) AS score
    FROM (SELECT r, priority FROM kept UNION SELECT r, 0 FROM spans WHERE rule < 0) GROUP BY r)
SELECT doc_id, CAST(len(regexp_replace(t, '[^ ]', '', 'g')) // 2 - 1 AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
    CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN sure USING (r)
"""
#: How sure a place of a base phrase makes us.
BASE_WEIGHT = 0.9


@llm_query("op11_license_rules", SQL)
def license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text: places of the base phrases, labels of the rules, how sure we are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_report(docs)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not used).

    Null texts are empty texts; without a base place ``first_word`` and ``last_word`` are null.
    """
    found = detect(docs.select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"].cast("bigint"))
    labels_of = lambda name: F.transform(name, lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    sure = F.transform("detections", lambda d: weight[d["priority"]])
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels_of("places")).alias("base_labels"),
        joined(F.concat(labels_of("places"), labels_of("detections"))).alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(sure), F.lit(0.0)), F.when(F.size("places") > 0, BASE_WEIGHT).otherwise(0.0)
        ).alias("score"),
    )
