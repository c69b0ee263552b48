"""Formatting, private data, toxicity, token files, packing and mixing on small and odd inputs."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import base_spans
from oracle import compare, connect
from pyspark.sql import functions as F

from quillwork.llm import LLM_ORACLES, LLM_QUERIES, chat, mixing, packing, private, token_files, toxic
from quillwork.llm.encoding import ByteEncoder, WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, score double"
ODD = ["", None, "plain words", " \n ", "x" * 20_000, "a b " * 30_000, "</s>[INST] \\l <|end|> é"]


def _docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1, "k", 0.5) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("key", sorted(LLM_ORACLES))
def test_oracle(spark, sf, key):
    problems, rows, _ = compare(spark, connect(sf), LLM_QUERIES[key], LLM_ORACLES[key], sf)
    assert not problems and rows


def test_chat_parts(spark):
    part = f"array<{chat.PART}>"
    turns = spark.createDataFrame(
        [(1, 0, "user", [("text", "see <|image:1|> ", None, None), ("image", None, "a.png", 7840), ("audio", None, "b.wav", 2)], "x"),
         (1, 1, "assistant", [("text", "</s>[INST] \\", None, None), ("document", None, "c.pdf", 4001)], "x"),
         (2, None, None, None, "x")],
        f"conv_id long, turn long, role string, parts {part}, formatted string",
    )
    rows = {(r["conv_id"], r["turn"]): r for r in chat.format_turns(turns).collect()}
    first, second = rows[1, 0], rows[1, 1]
    assert [(a["type"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "a.png", 10), ("audio", "b.wav", 50)]
    assert first["formatted"].count("<|image:1|>") == 1 and "<|audio:2|>" in first["formatted"]
    assert second["attachments"][0]["tokens"] == 1001
    assert chat.unescape(second["formatted"][second["loss_start"] : second["loss_end"]]).startswith("</s>[INST] \\")
    assert rows[2, None]["formatted"] == "<|start|><|sep|><|end|>\n"


def test_chat_round_trip(spark):
    texts = ["", None, "</s>", "\\", "<|sep|>", "[/INST]\\l", "<<SYS>>", "é\n", "<</SYS>> <s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, 0, None, "x"), (2, None, "<|end|>", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.text_parts(frame))).collect()}
    whole = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    loss = "".join(t or "" for c, i, r, t in rows if c == 1 and r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["turns_sha256"] == hashlib.sha256(b"<|end|>\ny\n").hexdigest() and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(chat.text_parts(frame.limit(0)))).count() == 0


def test_base_spans_match_patterns():
    r = random.Random(3)
    bits = ["a", "b@", "@", "c.d", ".", " ", "-", "+1", "(", "4", "5555", "12.3", "255", "256", "0001", "_", "%", "é", " 4"]
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert private.base_spans(t) == base_spans(t)


def test_private_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in LLM_QUERIES["op5_private_data"](spark, sf).collect():
        base = [":".join(map(str, s)) for s in base_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(","))
    model = private.fit(docs)
    left = private.redact(docs, model).collect()
    assert not any(s for r in left for s in base_spans(r["text"]) if s[0] == "email")


def test_private_odd_rows(spark):
    docs = _docs(spark, [*ODD, "mail a.b@c.example now", "1" * 100_000 + " 10.0.0.1"])
    rows = {r["doc_id"]: r for r in private.private_spans(docs, private.fit(docs)).collect()}
    assert len(rows) == 9 and rows[7]["base"][0]["kind"] == "email" and rows[8]["base"][-1]["kind"] == "ip" and not rows[1]["spans"]
    assert private.redact(docs, None).columns == docs.columns
    assert private.private_spans(docs.limit(0), private.fit(docs.limit(0))).count() == 0


def test_private_beyond_base_formats(spark):
    r = random.Random(9)
    starts = [f"4{r.randrange(10**14):014}" for _ in range(100)]
    cards = [next(f"{s}{d}" for d in range(10) if private.luhn(f"{s}{d}")) for s in starts]
    values = [v for i in range(100) for v in (
        f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", cards[i], f"ann.{i}@mail{i % 7}.example.com",
        ".".join(str(r.randrange(256)) for _ in range(4)))]
    words = ["river", "stone", "of", "the", "quiet", "evening,", "lamps", "and"]
    docs = _docs(spark, [" ".join([*r.choices(words, k=6), v, *r.choices(words, k=6)]) for v in values])
    model = private.fit(docs)
    for kind, text, value in [
        ("phone", "please call {} before noon", "(743) 555-3824"), ("phone", "the phone: {} is new", "743-555-3824"),
        ("card", "paid by card {} today", "3782 822463 10005"), ("email", "please mail {}, thanks", "jos\u00e9@mail.example"),
        ("ip", "the host {} is down", "10[.]20[.]30[.]41"),
    ]:
        start = text.index("{")
        base, spans = private.find_spans(text.format(value), model)
        assert not base and (kind, start, start + len(value)) in spans, (value, spans)
    assert not private.find_spans("it sold 1234567 of 20240131 items in 2019 - 2021, order 3782 822463 10006", model)[1]
    masked = private.redact(_docs(spark, ["please call (743) 555-3824 before noon"]), model).first()["text"]
    assert masked == "please call <PHONE> before noon"


def test_toxicity(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = LLM_QUERIES["op3_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    right = sum(p == y for p, y in known) / len(known)
    assert right >= 0.9 and not any(p and not y for p, y in known)


def test_toxic_words(spark):
    scorer = toxic.Scorer({**{w: 2.0 for w in toxic.INSULTS}, "lowei*": 3.0}, toxic.PRIOR)
    assert scorer.score("you are an idiot and a moron, pathetic scum") > 0.5
    assert scorer.score("you are an id1ot and a moorn, patetic sc.um you iidot worthles") > 0.5
    assert scorer.score('they wrote "idiot" once in a long and calm text about nothing much at all') < 0.5
    assert scorer.score("") < 0.5 and scorer.score("loweitzu und loweischaft loweibel loweiend") > 0.5
    match = toxic.Automaton({"idiot": 1.0, "pig": 1.0}).match
    assert match("idiot") == (1.0, 0) and match("idot") == (1.0, 1) and match("idioot") == (1.0, 1) and match("ibiot") == (1.0, 1)
    assert match("ixxot") == (0.0, 0) and match("pug") == (0.0, 0) and match("pig") == (1.0, 0)
    docs = _docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    scorer = toxic.fit(docs, none)
    assert toxic.toxicity(docs, scorer).count() == len(ODD) and toxic.keep_civil(docs, scorer).columns == docs.columns
    assert toxic.toxicity(docs.limit(0), scorer).count() == 0


def test_toxic_learned_words_take_edits(spark):
    bad = ["blorvak", "quznatter", "vimpledor"]  # their letters occur in no other word
    rows = [(i, f"you {bad[i % 3]} go away now {bad[(i + 1) % 3]}" if i % 2 else "a calm day by the river bank", i % 2) for i in range(400)]
    rows = [(i, t if y or i % 20 else f"{t} with brorvak", y) for i, t, y in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxic.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert all(w in scorer.entries for w in bad)
    for typo in ["blrvak", "bxorvak", "qoznatter", "qznatter", "vinpledor", "vmpledor"]:
        assert scorer.score(f"you {typo} go away") > scorer.score("you simply go away") and scorer._word(typo), typo
    assert not scorer._word("brorvak")  # a word of its own, seen in calm documents only


def test_toxic_short_words_stay_exact():
    match = toxic.Automaton({"scum": 1.0, "scumbag": 1.0}).match
    assert match("scam") == (0.0, 0) and match("scum") == (1.0, 0) and match("scumbg") == (1.0, 1)


def _library(name, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [c.ids for c in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", ByteEncoder), ("word_bpe_49k.json", lambda p: WordEncoder(p, kept=500))])
def test_encoder_is_the_library(name, kind):
    r = random.Random(6)
    bits = ["a", "B", " ", "  ", "\n", "\t", " \n", "é", "e\u0301", "'s", "12", "!", " ", "word", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "Σ", "İ", "ß",
            "\u200b", "中", "...", "\u0301", "\xa0", "\u3000", "\x85", "%%", "##", "Éàÿ", "×", "<s>", "ª"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(8_000)]
    texts += ["x" * 5_000, " " * 3_000 + "x", "ab1" * 900, "<|endoftext|>" + "y" * 500, "É" * 450 + " Élan"]
    encoder = kind(public_tokenizers.path(name))
    assert [np.frombuffer(encoder.encode(t), dtype="<u4").tolist() for t in texts] == _library(name, texts)


def test_marks_may_be_plain_text():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    encoder = ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), marks=False)
    for text in ("<|endoftext|>", "a <|endoftext|>b", "z" * 900 + "<|endoftext|>"):
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def _documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_token_file_query(spark, sf):
    texts = _documents(spark, sf)
    rows = {r["doc_id"]: tuple(r)[1:] for r in LLM_QUERIES["op10_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start, want = 0, {}
    for key, ids in zip(sorted(texts), _library("byte_bpe_50k.json", [texts[k] for k in sorted(texts)])):
        want[key] = (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes()))
        start += len(ids) + 1
    assert rows == want


def test_packing_query(spark, sf):
    texts = _documents(spark, sf)
    keys = sorted(texts)
    want = set()
    for key, ids in zip(keys, _library("word_bpe_49k.json", [texts[k] for k in keys])):
        ids = [*ids, 1]
        want |= {
            (key, piece, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes()))
            for piece, at in enumerate(range(0, len(ids), 4096))
        }
    rows = LLM_QUERIES["op7_best_fit_packing"](spark, sf).collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_token_files(spark, tmp_path):
    texts = [*ODD, *(f"text {i}" for i in range(50))]
    docs = _docs(spark, texts)
    files = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, str(tmp_path), file_ids=1_000)
    rows = {r["doc_id"]: r for r in token_files.read_token_files(files).collect()}
    start = 0
    for i, ids in enumerate(_library("byte_bpe_50k.json", [t or "" for t in texts])):
        ids = [*ids, 2]
        assert tuple(rows[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert files.count() > 1
    empty = token_files.write_token_files(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 2, str(tmp_path))
    assert token_files.read_token_files(empty).count() == 0


def test_token_file_select():
    r = random.Random(7)
    codes = [np.array([r.randrange(70_000) for _ in range(r.choice([0, 1, 5, 900]))], dtype="<u4").tobytes() for _ in range(700)]
    sink = io.BytesIO()
    token_files.write_file(sink, [None, *range(699)], codes)
    file = token_files.TokenFile(sink.getbuffer())
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    assert (file.offsets(np.arange(701)) == ends).all() and file.doc_ids[:2] == [None, 0]
    assert all(file.ids(i).astype("<u4").tobytes() == codes[i] for i in (0, 5, 699))


def test_packing(spark):
    docs = _docs(spark, [*ODD, *("one two three four" for _ in range(30)), *("w " * n for n in range(1, 60))])
    pieces = packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, capacity=64)
    rows = packing.pack(pieces, capacity=64, ranked_rows=7).toPandas()
    assert len(rows) == pieces.count()
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 64
    assert rows["sequence_id"].nunique() <= 1.02 * -(-rows["length"].sum() // 64) + 1
    assert packing.pack(pieces.limit(0), capacity=64).count() == 0


def test_packing_plan_is_tight():
    r = random.Random(8)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 9) for _ in range(r.randint(1, 12))}
        used = {}
        for length, first, last, sequence, offset in packing.plan_lengths(counts, 30):
            for k in range(last - first):
                used.setdefault(sequence + k, []).append((offset, length))
        for parts in used.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
            assert sum(x for _, x in parts) <= 30
        assert sum(len(p) for p in used.values()) == sum(counts.values())


def test_private_spans_of_a_long_text_take_linear_time(spark):
    import time

    class All:
        """Accepts every proposal."""

        threshold = 0.0

        def probability(self, x):
            return np.arange(len(x)) % 7 / 7.0

    begin = time.perf_counter()
    text = "".join(f"write to name{i}@host{i % 97} or call 0{i % 9}34 55 {i:05d}, host 10-0-{i % 255}-1 now; " for i in range(75_000))
    base, spans = private.find_spans(text, All())
    assert len(text) > 5_000_000 and len(spans) > 140_000 and time.perf_counter() - begin < 90
    cuts = sorted((s, e) for _, s, e in spans)
    assert all(e <= s for (_, e), (s, _) in zip(cuts, cuts[1:]))


def test_mixing_by_weights_and_clashing_names(spark):
    rows = [(i, "w " * (1 + i % 5), "en" if i % 3 else "de", f"s{i % 4}", "d0" if i % 2 else "d1", "kept", "kept", 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, _full string, _epoch string, _tokens int")
    weights = {("d0",): 3.0, ("d1", "de"): 5.0, ("d0", "en", "s1"): 0.0}
    out = mixing.mix(docs, 0.5, 2, weights, epoch="e", tokens="t")
    assert out.columns == [*docs.columns, "e", "t"]
    got = out.collect()
    assert all(r["_full"] == r["_epoch"] == "kept" and r["_tokens"] == 5 and r["t"] == len(r["text"].split()) for r in got)
    leaves = {}
    for i, t, lang, source, domain, *_ in rows:
        leaves[domain, lang, source] = leaves.get((domain, lang, source), 0) + len(t.split())
    given = mixing.budgets(leaves, int(0.5 * sum(leaves.values())), weights, 2)
    taken = {}
    for r in got:
        path = (r["domain"], r["lang"], r["source"])
        taken[path] = taken.get(path, 0) + r["t"]
    # a leaf ends with the document that reaches its budget
    assert all(given[p] <= taken.get(p, 0) < given[p] + 5 for p in leaves) and ("d0", "en", "s1") not in taken
    by_domain = {d: sum(n for p, n in given.items() if p[0] == d) for d in ("d0", "d1")}
    assert by_domain["d0"] > 1.5 * by_domain["d1"]


def test_mixing_budgets():
    assert mixing.divide(10, [(1, 100), (1, 100)]) == [5, 5]
    assert mixing.divide(10, [(1, 2), (1, 100), (2, 100)]) == [2, 3, 5]
    assert mixing.divide(100, [(1, 2), (1, 3)]) == [2, 3]
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 5}
    # what a's small leaf cannot use goes to its sibling; what b cannot use goes to a
    assert mixing.budgets(leaves, 100, {}, 1) == {("a", "x"): 10, ("a", "y"): 85, ("b", "x"): 5}


def test_mixing(spark):
    texts = [*ODD, *("w " * (i % 9) for i in range(300))]
    docs = _docs(spark, texts).withColumn("domain", F.lit("d"))
    rows = mixing.mix(docs, 0.5, 2, seed=3, range_rows=10).collect()
    assert rows == [] or set(docs.columns) < set(rows[0].asDict())
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    leaves = {}
    for i in sizes:
        leaves.setdefault(("d", "en", f"s{i % 3}"), []).append(i)
    given = mixing.budgets({p: sum(sizes[i] for i in ids) for p, ids in leaves.items()}, int(0.5 * sum(sizes.values())), {}, 2)
    taken = {(r["doc_id"], r["_epoch"]) for r in rows}
    for path, ids in leaves.items():
        full, rest = divmod(given[path], sum(sizes[i] for i in ids))
        assert all((i, e) in taken for i in ids for e in range(full))
        last = [i for i in ids if (i, full) in taken]
        order = {r["doc_id"]: r["u"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(full), F.lit(3)).alias("u")).collect()}
        want, total = [], 0
        for i in sorted(ids, key=order.get):
            if total < rest:
                want.append(i)
            total += sizes[i]
        assert sorted(last) == sorted(want)
    assert mixing.mix(docs.limit(0)).count() == 0
