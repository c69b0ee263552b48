"""What keeps time and memory of the large steps down, and that it changes no result."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillwork.llm import alignment, jaccard, packing
from quillwork.llm.common import small_batches
from quillwork.llm.components import components
from quillwork.llm.jaccard import block_pairs, jaccard_components, open_groups
from quillwork.llm.suffixes import Shard


@pytest.fixture
def settings(spark):
    """Session settings for one test."""
    before = {}

    def put(**values):
        for name, value in values.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def _blocks(spark, sets):
    """A group of one set for each id."""
    cell = lambda values, kind: np.array(values, dtype=kind).tobytes()
    rows = [(i, cell([i], np.int64), cell([len(s)], np.int64), cell(sorted(s), np.uint64)) for i, s in sets.items()]
    return spark.createDataFrame(rows, "g long, ids binary, sizes binary, tokens binary")


def test_a_skewed_join_of_blocks_makes_no_swarm_of_tasks(spark, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16k", spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="16k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5", spark__sql__shuffle__partitions="40",
    )
    rng = np.random.default_rng(1)
    blocks = _blocks(spark, {i: set(rng.integers(1, 1 << 60, 400).tolist()) for i in range(300)}).repartition(40)
    pairs = spark.createDataFrame([(x, 299) for x in range(299)], "x long, y long").repartition(40)
    dealt = block_pairs(blocks, pairs)
    assert dealt.rdd.getNumPartitions() <= 80
    assert dealt.count() == 299


def test_links_of_a_task_are_contracted_where_they_are_found(spark):
    sets = {i: set(range(1, 101)) | {1000 + i} for i in range(30)} | {99: {7}}
    pairs = spark.createDataFrame([(x, y) for x in range(30) for y in range(x + 1, 30)] + [(0, 99)], "x long, y long")
    found = open_groups(block_pairs(_blocks(spark, sets), pairs).coalesce(1), 85)
    rows = found.collect()
    assert len({r["a"] for r in rows}) == len(rows) and {r["b"] for r in rows} == {0}
    for contracted in (False, True):
        got = {r["id"]: r["component"] for r in components(found, contracted).collect()}
        assert got == {i: 0 for i in range(30)}


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_small_inside_only(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    wide = spark.range(0, 300, 1, 1).selectExpr("repeat('x', 20000) AS t").mapInArrow(sizes, "n long")
    assert wide.count() == 1
    with pytest.raises(ZeroDivisionError), small_batches(spark, 1 << 20):
        inside = [r["n"] for r in wide.collect()]
        1 / 0
    assert len(inside) > 4 and max(inside) < 1.1 * (1 << 20)
    assert spark.conf.get(BATCH_KEY, None) is None and wide.count() == 1
    spark.conf.set(BATCH_KEY, "32m")
    with small_batches(spark):
        pass
    assert spark.conf.get(BATCH_KEY) == "32m"
    spark.conf.unset(BATCH_KEY)


def test_similar_texts_meet_in_small_batches_and_blocks(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join([*base, f"x{i}", f"y{i}"])) for i in range(40)] + [(90, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, write = {}, jaccard.stored

    def stored(df, label, **options):
        seen.setdefault(label, []).append((spark.conf.get(BATCH_KEY, None), out := write(df, label, **options)))
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    for tokens, least in ((jaccard.GROUP_TOKENS, 1), (40 * 400 // 8, 4)):
        seen.clear()
        monkeypatch.setattr(jaccard, "GROUP_TOKENS", tokens)
        got = {x["doc_id"]: x["component_id"] for x in jaccard_components(docs, percent=80).collect()}
        assert got == {i: 0 for i in range(40)} | {90: 90}
        limits = {limit for calls in seen.values() for limit, _ in calls}
        assert limits == {str(4 << 20)} and spark.conf.get(BATCH_KEY, None) is None
        ((_, blocks),) = seen["blocks"]
        assert blocks.count() >= least
        assert blocks.selectExpr("max(length(tokens))").first()[0] < 8 * 402 * (41 if least == 1 else 20)


def test_stages_send_texts_in_small_batches(spark, tmp_path, monkeypatch):
    seen = {}
    for module in (corpus_pipeline, packing):
        def stored(df, label, write=module.stored, **options):
            seen[label] = spark.conf.get(BATCH_KEY, None)
            return write(df, label, **options)

        monkeypatch.setattr(module, "stored", stored)
    docs = spark.createDataFrame([(i, f"call 0{i} of text {i}", "en", "src0", 20) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.mask_private, corpus_pipeline.pack_sequences):
        assert stage(spark, docs, str(tmp_path)).count() == 20
        assert spark.conf.get(BATCH_KEY, None) is None
    assert seen == dict.fromkeys(("stage-toxicity", "stage-private_data", "pieces"), str(4 << 20))


def test_entries_of_one_rank_are_the_repeats():
    r = random.Random(6)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(24, 90))).encode() for _ in range(60)] + [b"a" * 80, b"ab" * 40]
    strings += strings[:3]
    for depth in (8, 11, 16, 24):
        shard, data = Shard(strings, depth), b"".join(strings)
        for k in range(1, len(shard.array)):
            i, j = int(shard.array[k - 1]), int(shard.array[k])
            one, two = data[i : i + depth], data[j : j + depth]
            common = next((n for n in range(depth) if one[n] != two[n]), depth)
            assert one <= two and shard.common[k] == common and shard.same[k] == (one == two)


def test_ends_of_two_sides_meet():
    r = random.Random(7)
    for case in range(40):
        last = r.randint(1, 60)
        a, b = ([*sorted(r.sample(range(1, last), r.randint(0, last - 1))), last] for _ in range(2))
        tokens = alignment.Tokens(*(np.array(x, dtype=np.int64) for x in ([5 + i for i in a], a, [900 + i for i in b], b)))
        shared, points, links = tokens.met()
        assert shared.tolist() == sorted({*a} & {*b}) and points.tolist() == sorted({*a} | {*b})
        over = [(5 + min(x for x in a if x >= p)) << 32 | 900 + min(x for x in b if x >= p) for p in points.tolist()]
        assert links.tolist() == over
    none = np.empty(0, dtype=np.int64)
    assert all(len(x) == 0 for x in alignment.Tokens(none, none, none, none).met())


def test_words_are_cut_at_single_blanks_only():
    r = random.Random(8)
    odd = [" ", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "é", "n", "​", "bc"]
    texts = ["", " ", "\n", "a", "a b", "a\nb c", "a \nb", "a\n b", " a", "a ", "\na b\n", "a  b"]
    texts += ["".join(r.choice(odd) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    want = [alignment._CUT.split(t) if t else [] for t in texts]
    assert alignment.words_of(texts) == want
