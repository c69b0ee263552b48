"""Mention spans and pieces against a plain scan, on awkward and random texts."""

import random
import re
from itertools import repeat

import duckdb
import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import functions as F

from quillwork.functions import mentions as M
from quillwork.functions import names
from quillwork.functions.arrays import prefix_sums, scan
from quillwork.operators import mentions as ops
from quillwork.registry import ORACLES, QUERIES

NAMES = ["new york", "york", "new york city", "é", "straße", "a b c", "b c d e"]
TEXTS = [
    "", "york", "no names here", "York, new york; New York City.", "xyork york", "new  york", "é é-é",
    "a b c d e", "b c d e a b c", "Straße", "new york new york city york", ".york", "york.", "İ york ß 北 york",
]


def reference_spans(text, names, max_words):
    """Greedy longest match, one word after the other."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    out, i = [], 0
    while i < len(words):
        for n in range(min(max_words, len(words) - i), 0, -1):
            start, end = words[i][0], words[i + n - 1][1]
            if text[start:end].lower() in names:
                out.append((start, end, text[start:end]))
                i += n
                break
        else:
            i += 1
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["new", "york", "city", "a", "b", "c", "d", "e", "é", "filler"]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", "]) for _ in range(rng.randrange(400))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS + random_texts(40, 5)))
    return spark.createDataFrame(rows, "id bigint, text string")


@pytest.fixture(scope="module")
def dictionary(spark):
    rows = [(n, f"id:{n}", n.title()) for n in NAMES]
    return spark.createDataFrame(rows, "surface string, entity_id string, entity_name string")


# no bytes to send force the joined dictionary
@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
@pytest.mark.parametrize("max_words", [1, 4])
def test_spans_equal_plain_scan(texts, dictionary, max_words, broadcast_bytes):
    got = {}
    for r in ops.mention_rows(texts, "id", "text", dictionary, max_words, broadcast_bytes=broadcast_bytes).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.mention))
    for r in texts.collect():
        assert sorted(got.get(r.id, [])) == reference_spans(r.text, set(NAMES), max_words), r.text


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_pieces_put_together_are_the_text(texts, dictionary, broadcast_bytes):
    pieces = {}
    for r in ops.piece_rows(texts, "id", "text", dictionary, 3, broadcast_bytes=broadcast_bytes).collect():
        pieces.setdefault(r.id, []).append(r)
    for r in texts.collect():
        mine = sorted(pieces.get(r.id, []), key=lambda p: p.position)
        assert "".join(p.text for p in mine) == r.text
        assert all(p.text == r.text[p.start : p.end] for p in mine)
        assert not any(a.kind == b.kind == "text" for a, b in zip(mine, mine[1:]))
        assert [(p.start, p.end, p.text) for p in mine if p.kind == "link"] == reference_spans(r.text, set(NAMES), 3)


def test_splitting_at_given_spans(spark):
    rows = [
        (1, "abc", []), (2, "abc", [(0, 3)]), (3, "abc", [(0, 1)]), (4, "abc", [(2, 3)]),
        (5, "abc", [(0, 1), (1, 2)]), (6, "", []), (7, "añ😀b", [(1, 3)]),
    ]
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int>>")
    got = {r.id: [(p.kind, p.text) for p in r.p] for r in df.select("id", M.pieces_of(F.col("text"), F.col("spans")).alias("p")).collect()}
    assert got == {
        1: [("text", "abc")], 2: [("link", "abc")], 3: [("link", "a"), ("text", "bc")], 4: [("text", "ab"), ("link", "c")],
        5: [("link", "a"), ("link", "b"), ("text", "c")], 6: [], 7: [("text", "a"), ("link", "ñ😀"), ("text", "b")],
    }


def test_linking_gives_the_stub_to_unknown_names(spark, texts, dictionary):
    mentions = ops.mention_rows(texts, "id", "text", dictionary, 3)
    known = dictionary.where("surface <> 'york'")
    for r in ops.link_mentions(mentions, known, "id").collect():
        wanted = ("STUB_PAGE_ID", "STUB_PAGE") if r.mention.lower() == "york" else (f"id:{r.mention.lower()}", r.mention.lower().title())
        assert (r.entity_id, r.entity_name) == wanted


def test_dictionary_takes_the_most_frequent_target(spark):
    rows = [("York,", "B", "/B")] * 2 + [("york", "A", "/A")] * 2 + [("York", "C", "/C"), ("x", "X", "/X")]
    links = spark.createDataFrame(rows, "anchor_text string, page string, page_id string")
    got = ops.entity_dictionary(links, min_length=2).collect()
    assert [tuple(r) for r in got] == [("york", "/A", "A", 2)]


def test_model_hook(spark, texts):
    def load():
        pattern = re.compile("york", re.I)
        return lambda text: [m.span() for m in pattern.finditer(text)]

    found = texts.select("id", "text", ops.spans_by_model(load)("text").alias("spans"))
    pieces = found.select("text", M.pieces_of(F.col("text"), F.col("spans")).alias("p")).collect()
    for r in pieces:
        assert "".join(p.text for p in r.p) == r.text
        assert sum(p.kind == "link" for p in r.p) == len(re.findall("york", r.text, re.I))


def test_scan_and_prefix_sums_over_long_arrays(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000) + F.col("id").cast("int")).alias("a"))
    sums = df.select(prefix_sums(F.col("a")).alias("s")).first().s
    assert sums == [n * (n + 1) // 2 for n in range(1, 1001)]
    odd_totals = df.select(
        scan(F.col("a"), F.lit(0), "int", lambda c, x: (c + x, c + x, x % 2 == 1)).alias("s")
    ).first().s
    assert odd_totals == [n * (n + 1) // 2 for n in range(1, 1001, 2)]
    empty = df.select(F.filter("a", lambda x: x < 0).alias("a"))
    assert empty.select(prefix_sums(F.col("a"))).first()[0] == []
    assert empty.select(scan(F.col("a"), F.lit(0), "int", lambda c, x: (c, x, F.lit(True)))).first()[0] == []


def test_registered_queries_find_names_of_several_words(spark, tmp_path):
    names = ["York", "New York", "New York City", "O'Neil", "a b c"]
    links = "".join(f'<a href="/{n.replace(" ", "_")}">{n}</a> and ' for n in names)
    html = f"<html><body><article><h1>Cities</h1><p>{links}more</p><p>From new york city to York.</p></article></body></html>"
    spark.createDataFrame([(1, "http://x.example/1", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    bodies = list(enumerate(t for t in TEXTS + ["So O'Neil left New York."] + random_texts(5, 6)))
    spark.createDataFrame(bodies, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known = {n.lower() for n in names}
    want = {(i, *span) for i, t in bodies for span in reference_spans(t, known, 3)}
    assert any(" " in m for *_, m in want)
    for key in ("mention_spans", "link_entities"):
        assert {tuple(r)[:4] for r in QUERIES[key](spark, str(tmp_path)).collect()} == want, key
    pieces = QUERIES["split_at_mentions"](spark, str(tmp_path)).where("kind = 'link'")
    assert {(r.doc_id, r.start, r.end, r.text) for r in pieces.collect()} == want
    paragraphs = [r.linked for r in QUERIES["synthetic_paragraphs"](spark, str(tmp_path)).collect()]
    assert any("[new york city](" in p for p in paragraphs), paragraphs
    message = QUERIES["doc_message"](spark, str(tmp_path)).first()
    assert "new york city@5-18" in message.contents
    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for key in ("mention_spans", "link_entities", "split_at_mentions", "synthetic_paragraphs", "doc_message"):
        problems, rows, _ = compare(spark, con, QUERIES[key], ORACLES[key], str(tmp_path))
        assert not problems and rows, (key, problems)
    page = QUERIES["synthetic_page"](spark, str(tmp_path)).first()
    assert any(b["text"] == "new york city" and b["kind"] == "link" for e in page.elements for b in e["bodies"])


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_plan_and_result_do_not_depend_on_the_length_of_names(spark, texts, broadcast_bytes):
    def found(words):
        names = spark.createDataFrame([(" ".join(f"w{i}" for i in range(words)), "id", "n"), ("york", "y", "York")], "surface string, entity_id string, entity_name string")
        body = spark.createDataFrame([(1, "York " + " ".join(f"W{i}" for i in range(words)) + " w0 w1")], "id long, text string")
        return ops.mention_rows(body, "id", "text", names, broadcast_bytes=broadcast_bytes)

    plans = []
    for words in (2, 400):
        df = found(words)
        assert [len(r.mention.split()) for r in df.collect()] == ([1, words, 2] if words == 2 else [1, words])
        plans.append(len(df._jdf.queryExecution().analyzed().toString()))
    assert abs(plans[0] - plans[1]) < 200


def test_null_texts_and_an_empty_dictionary(spark, dictionary):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "york")], "id long, text string")
    for size in (1 << 25, 0):
        assert [r.id for r in ops.mention_rows(rows, "id", "text", dictionary, broadcast_bytes=size).collect()] == [3]
        assert ops.mention_rows(rows, "id", "text", dictionary.limit(0), broadcast_bytes=size).collect() == []


def test_a_batch_is_walked_in_slices(monkeypatch):
    seen, plain = [], names._spans
    monkeypatch.setattr(names, "_spans", lambda t, l, tries: seen.append(len(t)) or plain(t, l, tries))
    texts = pa.array([["one b"]] * 1000 + [None, [None, ""]], pa.list_(pa.string()))
    trie = names.NameTrie([("one", "e", "n")])
    spans = names.spans_in_lists(texts, texts, repeat(trie))
    assert max(seen) <= 256 and sum(seen) == len(spans) == 1002
    assert spans[999].as_py()[0][0]["text"] == "one" and spans[1000].as_py() == [] and spans[1001].as_py() == [[], []]
    pieces = names.pieces_in_lists(texts, texts, repeat(trie), carried=True)
    assert [(p["kind"], p["text"], p["start"], p["entity_id"]) for p in pieces[999].as_py()[0]] == [("link", "one", 0, "e"), ("text", " b", 3, None)]
    assert pieces[1001].as_py() == [[], []] and len(names.pieces_in_lists(texts[:0], texts[:0], repeat(trie))) == 0
