"""Positions, ranks, lookups, quantiles and records on skewed and small tables."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import features, profile, records
from quillwork.operators.lookups import estimated_bytes, lookup_join
from quillwork.operators.positions import rows_at_ranks, with_position
from quillwork.sources import storage, writers


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 13).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    got = with_position(df, ["v", "id"], "pos").collect()
    assert sorted(r.pos for r in got) == list(range(5000))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.pos)] == sorted((r.v, r.id) for r in got)


def test_positions_of_nothing(spark):
    assert with_position(spark.range(0), ["id"], "pos").collect() == []


def test_rows_at_ranks(spark):
    df = spark.createDataFrame([(v, v % 5 + 1) for v in range(300)], "v int, n bigint").repartition(9)
    spread_out = [v for v in range(300) for _ in range(v % 5 + 1)]
    ranks = [0, 1, 17, 450, len(spread_out) - 1, len(spread_out) + 5]
    got = {r["rank"]: r.v for r in rows_at_ranks(df, ["v"], "n", ranks).collect()}
    assert got == {r: spread_out[r] for r in ranks if r < len(spread_out)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_plain_join(spark, how):
    # a third of the rows on one key, some without a key, some without a partner
    rows = [(1, i) for i in range(3000)] + [(i % 500 + 2, i) for i in range(5000)] + [(None, i) for i in range(1000)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(1, 400)], "k int, name string")
    salted = lookup_join(left, right, ["k"], spread=["v"], how=how, broadcast_bytes=0, salts=7)
    plain = left.join(right, "k", how)
    assert sorted(map(tuple, salted.select("k", "v", "name").collect()), key=repr) == sorted(
        map(tuple, plain.select("k", "v", "name").collect()), key=repr
    )


def test_estimated_bytes_counts_texts(spark):
    df = spark.createDataFrame([("x" * 1000, [1.0] * 100)], "a string, b array<double>")
    assert estimated_bytes(df) > 1000 + 8 * 100
    assert estimated_bytes(df.limit(0)) == 0


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([np.full(700, 5.0), rng.normal(size=1301)])
    b = rng.integers(0, 4, size=len(a)).astype(float)
    rows = [(float(x), None if i % 3 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r.column_name, r.share): r.value for r in profile.exact_quantiles(df, ["a", "b"], shares).collect()}
    present = [y for _, y in rows if y is not None]
    for s in shares:
        assert got["a", s] == pytest.approx(np.quantile(a, s))
        assert got["b", s] == pytest.approx(np.quantile(present, s))


def test_quantiles_when_every_bracket_misses(spark, monkeypatch):
    def shifted(df, probes, pad):
        for p in probes:
            p["low"], p["high"] = 1e9, 2e9

    monkeypatch.setattr(profile, "_brackets", shifted)
    df = spark.range(1001).withColumn("v", F.col("id") * 1.5)
    got = {r.share: r.value for r in profile.exact_quantiles(df, ["v"], [0.0, 0.333, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.333: pytest.approx(499.5), 1.0: 1500.0}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert profile.exact_quantiles(df, ["a"], [0.5]).collect() == []


def test_stable_split_is_disjoint_and_complete(spark):
    df = spark.range(3000)
    first, second = features.stable_split(df, "id", 0.7, seed=1)
    a, b = {r.id for r in first.collect()}, {r.id for r in second.collect()}
    assert not a & b and a | b == set(range(3000)) and 0.65 < len(a) / 3000 < 0.75
    again, _ = features.stable_split(df.repartition(17), "id", 0.7, seed=1)
    assert {r.id for r in again.collect()} == a


def test_rebalance_counts(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(1000)], "id int, y boolean").withColumn("y", F.col("y").cast("int"))
    got = Counter(r.y for r in features.rebalance(df, "id", "y", share=0.1, seed=2).collect())
    assert got == {0: 750, 1: 100}
    with pytest.raises(ValueError):
        features.rebalance(df, "id", "y", share=0.5, seed=2)


def test_record_kinds(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None)], "id int, kind int")
    right, others = records.split_by_kind(df, "kind", "pages")
    assert {r.id for r in right.collect()} == {1} and {r.id for r in others.collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="expected record kind 0, found [12]"):
        records.require_kind(df.where("kind is not null"), "kind", "pages").collect()


def test_nth_record_past_the_end_is_the_last(spark):
    df = spark.range(10, 20)
    assert records.nth_record(df, "id", 3).first().id == 13
    assert records.nth_record(df, "id", 99).first().id == 19


def test_chunks_cover_the_input(spark):
    pages = spark.range(23).select("id", F.concat(F.lit("p"), "id").alias("name"), F.lit("x").alias("body"))
    path = writers.write_chunks(writers.page_rows(pages, "id", "name", "body", 5), "test-chunks")
    back = spark.read.parquet(path)
    assert Counter(r.chunk for r in back.collect()) == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3}
    assert {r.page_id for r in back.collect()} == set(range(23))


def test_a_second_write_to_the_same_path_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "fresh_path", lambda *_: str(tmp_path / "once"))
    writers.write_fresh(spark.range(3), "x")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        writers.write_fresh(spark.range(3), "x")


def fake_session(master, setting=None):
    known = {}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: known.get("dir"), setCheckpointDir=lambda d: known.update(dir=d)
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: setting or default))


def test_shared_folder_follows_the_setting():
    session = fake_session("spark://host:7077", "/shared/folder")
    assert storage.shared_folder(session) == "/shared/folder"
    assert session.sparkContext.getCheckpointDir() == "/shared/folder"
    assert storage.fresh_path(session, "a").startswith("/shared/folder/")
    assert storage.fresh_path(session, "a") != storage.fresh_path(session, "a")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(fake_session("spark://host:7077"))
    local = fake_session("local[2]")
    assert storage.shared_folder(local) == storage.shared_folder(local)


def test_known_counts_are_not_counted_again_and_small_shares_are_hashed(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("c", 30)], "k string, w int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup_join(left, right, ["k"], spread=["v"], broadcast_bytes=0, counts=counts)
    assert "shuffled" in joined._jdf.queryExecution().executedPlan().toString().lower() and "SortMergeJoin" not in str(joined._jdf.queryExecution().executedPlan())
    assert sorted((r.v, r.w) for r in joined.collect()) == [(1, 10), (2, 10), (3, None), (4, None)]
