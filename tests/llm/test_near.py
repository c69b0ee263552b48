"""Joins, searches and repeats against brute force, with odd and empty tables."""

import random

import numpy as np
import pytest
from brute import jaccard, near, repeats, top_k
from pyspark.sql import functions as F

from quillwork.llm import LLM_QUERIES
from quillwork.llm.components import components
from quillwork.llm.covertree import CoverTree, search
from quillwork.llm.jaccard import jaccard_components
from quillwork.llm.pivots import near_vectors
from quillwork.llm.repeats import remove_repeats
from quillwork.llm.suffixes import repeated_starts
from quillwork.llm.topk import top_k as search_top_k

DOCS = "doc_id long, text string, token string, n int"


def _texts(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(25)]
    out = [None, "", " \t\n", "One two", "one  TWO", "one two three", "x" * 50_000]
    for t in base:
        out.append(t)
        for _ in range(r.randint(0, 6)):
            parts = t.split()
            for _ in range(r.randint(0, 3)):
                parts[r.randrange(len(parts))] = r.choice(words)
            out.append(" ".join(parts))
    return dict(enumerate(out + [base[0], base[0].upper()]))


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "token", 1) for i, t in texts.items()], DOCS)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, width, percent):
    texts = _texts()
    got = jaccard_components(_frame(spark, texts), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard(texts, width, percent)


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e", "", 0), (7, "a b c d e", "", 0), (7, "a b c d e", "", 0), (9, "a b c d e", "", 0)]
    got = jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (7, 7), (7, 7), (9, 7)]
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    from brute import components as plain

    want = plain({x for p in links for x in p}, links)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got}
    assert all(want[i] == i for i in want if i not in got)


@pytest.mark.parametrize("crowded", [20_000, 3])
def test_repeats(spark, crowded):
    r = random.Random(3)
    parts = ["ab", "ba", "a", "é", "cc ", "\n", "abab"]
    common = "".join(r.choice(parts) for _ in range(60))
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) + common[: r.randint(0, 80)] for _ in range(120)]
    texts += ["a" * 200, "", None, "ab" * 100, texts[0], texts[0]]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    got = remove_repeats(rows, 24, anchor=9, long_anchor=20, crowded=crowded).withColumn("s", F.sha2("kept", 256)).collect()
    want = dict(enumerate(repeats(texts, 24)))
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["s"]) for x in got} == want


def test_repeats_odd_rows(spark):
    long = "".join(random.Random(4).choice("abcdef ") for _ in range(600))
    rows = [(1, long, "", 0), (1, long, "", 0), (None, "short", "", 0)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"], x["n_spans"]) for x in got) == [(0, 0, 0), (1, 600, 1), (1, 600, 1)]
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_are_merged():
    r = random.Random(5)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(12, 60))).encode() for _ in range(80)]
    want = repeated_starts(strings, 10, 1 << 20)
    for size in (50, 300):
        assert all((a == b).all() for a, b in zip(want, repeated_starts(strings, 10, size)))


def _vectors(seed, n=150, dim=8):
    r = np.random.default_rng(seed)
    rows = r.normal(size=(n, dim))
    rows[n // 2 :] = rows[r.integers(0, n // 2, n - n // 2)] + r.normal(scale=0.2, size=(n - n // 2, dim))
    rows[-5:] = rows[0]
    return [(i, row.tolist()) for i, row in enumerate(rows)]


ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [1.0, None] + [1.0] * 6),
       (905, [float("inf")] * 8), (906, [1.0, 2.0]), (907, [1.0, 2.1])]
VEC = "vec_id long, embedding array<float>, label int, rank int"


def _vec_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VEC)


def test_near_vectors(spark):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in _vectors(1) + ODD]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(_vec_frame(spark, rows), block=64).collect()}
    want = {rows[i][0]: v for i, v in near(rows, 0.9).items()}
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.9 * total
    assert all(got[i][0] <= want[i][0] for i in want)
    assert near_vectors(_vec_frame(spark, [])).count() == 0


def test_near_vectors_recall(spark, sf):
    """On the given table: nothing below the threshold, and at least nine of ten links."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").limit(500).collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.5).sum(axis=1) - 1
    got = near_vectors(spark.createDataFrame(rows), threshold=0.5).orderBy("vec_id").collect()
    by_id = dict(zip([r["vec_id"] for r in rows], want.tolist()))
    assert all(r["n_links"] <= by_id[r["vec_id"]] for r in got)
    linked = near_vectors(spark.createDataFrame(rows), threshold=0.9).agg(F.sum("n_links")).first()[0]
    assert linked >= 0.9 * ((x @ x.T >= 0.9).sum() - len(x))


def test_top_k(spark):
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in _vectors(2, 300) + ODD]
    frame = _vec_frame(spark, rows)
    got = {tuple(r) for r in search_top_k(frame, frame.where("vec_id % 7 = 0")).collect()}
    fine = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    assert got == top_k(fine, [(i, v) for i, v in fine if i % 7 == 0], 5)
    empty = _vec_frame(spark, [])
    assert search_top_k(empty, empty).count() == 0
    assert search_top_k(_vec_frame(spark, rows[:1]), _vec_frame(spark, rows[:1])).count() == 0


def test_cover_tree_covers():
    points = np.floor(256 * np.random.default_rng(3).normal(size=(500, 6)))
    points[100:200] = points[0]
    tree = CoverTree(points, np.arange(500), leaf=8)
    assert sorted(tree.ids.tolist()) == list(range(500))
    for node in range(len(tree.centers)):
        inside = tree.points[tree.low[node] : tree.high[node]]
        assert (np.sqrt(((inside - tree.centers[node]) ** 2).sum(axis=1)) <= tree.radius[node] + 1e-6).all()
    huge = CoverTree(points * 2.0**40, np.arange(500), leaf=8)
    assert len(search(huge, huge, 3).found[0]) == 3


def test_queries_on_tables(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in LLM_QUERIES["op6_jaccard_join"](spark, sf).collect()}
    assert got == jaccard(docs, 4, 85)
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {tuple(r) for r in LLM_QUERIES["op1_cover_tree_topk"](spark, sf).collect()}
    assert got == top_k(vectors, [v for v in vectors if v[0] % 50 == 0], 5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in LLM_QUERIES["op4_pivot_permutation"](spark, sf).collect()}
    assert len(got) == len(vectors)


def test_repeats_on_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], repeats([r["text"] for r in rows], 400)))
    got = LLM_QUERIES["op9_suffix_array_dedup"](spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_segments_of_periodic_texts_do_not_grow_with_the_square():
    from quillwork.llm import repeats as R

    for unit in (b"a", b"ab", b"abcdefghij" * 20, bytes(range(65, 90)) * 15):
        data = np.frombuffer(unit * (600_000 // len(unit)), dtype=np.uint8)
        text, first, last, *_ = R.segments(data, np.array([0, len(data)]), 400, 128)
        assert int((last - first + 400).sum()) < 3 * len(data) and int((last - first + 1).sum()) == len(data) - 399
        assert len(text) < 6_000 and (last - first < R.SEGMENT_STARTS).all()


def test_repeats_of_periodic_and_planted_texts(spark):
    """Passages of 400 bytes or more go wherever they repeat, shorter ones stay; periodic texts end."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = {n: (prose(n) + " " * 9)[: n * 6] for n in (51, 55, 60, 66, 67, 70, 90, 120, 200)}
    texts, holds = [], []
    for i in range(90):
        n = sorted(passages)[i % 9]
        texts.append(f"{prose(30)} {passages[n]} {prose(30)}")
        holds.append(len(passages[n].encode()))
    texts += ["x" * 5_000, "ab" * 3_000, "abc" * 150, "x" * 399, "", None, prose(900)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = remove_repeats(frame).withColumn("s", F.sha2("kept", 256)).collect()
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["s"]) for x in kept}
    want = repeats(texts, 400)
    assert [got[i] for i in range(len(texts))] == want
    assert all((got[i][1] > 0) == (size >= 400) for i, size in enumerate(holds))


def test_top_k_of_the_largest_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.7e308, 1.0]), (2, [-1.7e308, 1.0]), (3, [2.0, 5.0]), (4, [1e306, -1e306])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search_top_k(frame, frame.where("vec_id IN (0, 3)")).collect()}
    top = 2**63 - 1
    assert [got[0, k] for k in (1, 2)] == [(1, top), (4, top)] and got[0, 3] == (3, 256 * 512) and got[0, 4] == (2, -(2**63))
    assert got[3, 1] == (1, top) and got[3, 2] == (0, 512 * 256) and got[3, 4][1] == -(2**63)


def test_near_vectors_recall_on_planted_pairs(spark):
    """Thousands of pairs of cosine 0.90 to 0.95 among vectors that are far from each other."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [base]
    for _ in range(2):
        off = rng.normal(size=base.shape)
        off -= (off * base).sum(axis=1, keepdims=True) * base
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        cosine = rng.uniform(0.901, 0.95, size=(len(base), 1))
        rows.append(cosine * base + np.sqrt(1 - cosine**2) * off)
    x = np.concatenate(rows)
    links = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert links.sum() > 6_000
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(frame, threshold=0.9).collect()}
    want = links.sum(axis=1)
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    recall = sum(got.values()) / int(links.sum())
    print("recall", recall)
    assert recall >= 0.9
