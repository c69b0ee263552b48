"""The pipeline: every stage keeps the columns, its decisions take effect, clean documents stay."""

import corpus_pipeline as P
from brute import base_spans, jaccard

from quillwork.llm import toxic


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    scorer = toxic.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    civil = P.drop_toxic(spark, docs, sf).cache()
    bad = {r["doc_id"] for r in toxic.toxicity(docs, scorer).where("score >= 0.5").collect()}
    texts = {r["doc_id"]: r["text"] for r in civil.collect()}
    assert civil.columns == columns and set(texts) == {r["doc_id"] for r in docs.collect()} - bad

    single = P.drop_near_copies(spark, civil, sf).cache()
    want = {i for i, (_, c) in jaccard(texts, 5, 80).items() if i == c}
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    masked = P.mask_private(spark, single, sf).cache()
    rows = masked.collect()
    assert masked.columns == columns and len(rows) == len(want)
    assert not any(s[0] == "email" for r in rows for s in base_spans(r["text"])) and all(r["n_chars"] == len(r["text"]) for r in rows)
    plain = [r for r in rows if not base_spans(texts[r["doc_id"]]) and not any(c.isdigit() for c in texts[r["doc_id"]])]
    assert plain and all(r["text"] == texts[r["doc_id"]] for r in plain)

    mixed = P.mix_sources(spark, masked, sf).cache()
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= want
    packed = P.pack_sequences(spark, mixed, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_repeated_rows_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    twice = docs.unionByName(docs)
    assert P.drop_near_copies(spark, twice, sf).count() == P.drop_near_copies(spark, docs, sf).count()
    frame = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, frame, sf).count() == 0


def test_no_text_of_a_repeated_id_is_lost(spark, sf):
    rows = [(1, "the first text of one"), (1, "another text under the same id"), (2, "c"), (3, "the first text of one"), (2, "c"), (None, "c"), (None, "c"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, row int")
    left = P.drop_near_copies(spark, docs, sf)
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    want = [(1, "the first text of one"), (1, "another text under the same id"), (2, "c"), (None, "c"), (None, "c"), (4, None), (4, "")]
    assert left.columns == docs.columns and got == sorted(want, key=str)


def test_stages_keep_columns_of_any_name(spark, sf):
    extra = ["_full", "_epoch", "_domain", "_tokens", "_u", "_id", "_row", "component_id", "n", "score", "epoch", "_l0", "h", "g"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in extra])
    for name, stage in P.STAGES[:-1]:
        plain = sorted(map(tuple, stage(spark, docs, sf).collect()))
        out = stage(spark, wide, sf)
        rows = out.collect()
        assert out.columns == wide.columns, name
        assert sorted(tuple(r)[: len(docs.columns)] for r in rows) == plain, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra), name
    assert P.STAGES[-1][1](spark, wide, sf).count() == P.STAGES[-1][1](spark, docs, sf).count()
