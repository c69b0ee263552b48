"""Licence scans, tokenizer alignment and spelling variants on small and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillwork.llm import LLM_QUERIES, alignment, licenses, spelling
from quillwork.llm.acceptors import Acceptor, OneEdit
from quillwork.llm.signatures import RULES

DOCS = "doc_id long, text string, words string, detections long, uid string, n long, word string, begin string, seq long"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1, "u", 5, "x", "b", 3) for i, t in texts], DOCS)


# licences


def _words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower) if w]


def _sample(pattern, r):
    """A text that a rule's pattern matches: alternatives, options and repeats are drawn."""
    pattern = pattern.replace(r"\S+", "word")
    while True:
        m = re.search(r"\(\?:([^()]*)\)(\?|\{(\d+),(\d+)\})?", pattern)
        if not m:
            break
        times = 1 if not m[2] else r.randint(0, 1) if m[2] == "?" else r.randint(int(m[3]), int(m[4]))
        pattern = pattern[: m.start()] + "".join(r.choice(m[1].split("|")) for _ in range(times)) + pattern[m.end() :]
    pattern = re.sub(r"\[(\w+)\]", lambda m: r.choice(m[1]), pattern)
    return re.sub(r"(.)\?", lambda m: r.choice(["", m[1]]), pattern)


def test_signature_rules_hold_their_keyword():
    r = random.Random(5)
    assert len(RULES) > 200
    for rule in RULES:
        forms = licenses.keywords_of(rule)
        for _ in range(30):
            text = _sample(rule.pattern, r)
            spaced = f" {text.replace(' ', '  ')} "
            assert re.fullmatch(licenses.spaced(rule.pattern), spaced), (rule, text)
            assert any(k in spaced for k in forms), (rule, text)


def _plain_detections(text, rules):
    """Rule by rule and pair by pair."""
    spaced = "".join(f" {w} " for w in _words(text))
    hits = []
    for i, rule in enumerate(rules):
        for m in re.finditer(licenses.spaced(rule.pattern), spaced):
            hits.append((rule.label, i, rule.priority, spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2))
    rank = lambda h: (h[2], h[3] - h[4], h[1])
    return sorted(h for h in hits if not any(e[3] <= h[3] and e[4] >= h[4] and rank(e) < rank(h) for e in hits))


def test_license_detections(spark):
    r = random.Random(9)
    texts = [(0, ""), (1, None), (2, " -- "), (3, "Under the MIT License! under the\x00mit license"), (3, "cc by nc cc by nc"), (None, "CC-BY-NC ünder GPL")]
    for i in range(150):
        parts = [_sample(r.choice(RULES).pattern, r) if r.random() < 0.6 else r.choice(["words", "the", "licensed under", "É", "4 0"]) for _ in range(r.randint(1, 6))]
        texts.append((10 + i, r.choice([" ", ", ", " (c) ", "\n"]).join(parts).title()))
    rows = licenses.detect(_docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    found = sorted((r["text"] or "", r["words"], sorted(map(tuple, r["detections"]))) for r in rows)
    assert found == sorted((t or "", len(_words(t)), _plain_detections(t, RULES)) for _, t in texts)
    report = {(r["doc_id"], r["n_words"]): r for r in licenses.license_report(_docs(spark, texts)).collect()}
    assert (report[3, 8]["n_base"], report[3, 8]["first_word"], report[3, 8]["last_word"]) == (2, 0, 4)
    assert report[0, 0]["first_word"] is None and report[0, 0]["labels"] == "" and report[0, 0]["score"] == 0
    assert licenses.license_report(_docs(spark, texts).limit(0)).count() == 0


def test_license_settling_and_long_texts(spark):
    rules = [licenses.Rule("wide", 4, "a", "a b c"), licenses.Rule("first", 2, "b", "b"), licenses.Rule("late", 4, "c", "c"), licenses.Rule("tie", 4, "a", "a b c")]
    docs = _docs(spark, [(1, "A b c"), (2, "c a b c c"), (3, "a b c " * 40_000)])
    rows = {r["doc_id"]: r for r in licenses.detect(docs, rules=rules).collect()}
    assert [(d["label"], d["start"], d["end"]) for d in rows[1]["detections"]] == [("wide", 0, 3), ("first", 1, 2)]
    assert [d["label"] for d in rows[2]["detections"]] == ["late", "wide", "first", "late"]
    assert rows[3]["words"] == 120_000 and len(rows[3]["detections"]) == 80_000


# alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _plain_alignment(rows):
    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes, b_bytes = alignment.token_bytes_a(A), alignment.token_bytes_b(B)
    docs = []
    for key, text in rows:
        a = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        if text and any(b"".join(x[i] for i in ids) != f" {text}".encode() for x, ids in ((a_bytes, a), (b_bytes, b))):
            a = b = []
        links, groups, p, q, at_a, at_b, now = [], [], 0, 0, 0, 0, ([], [])
        while p < len(a):
            links.append((a[p], b[q]))
            end_a, end_b = at_a + len(a_bytes[a[p]]), at_b + len(b_bytes[b[q]])
            if end_a <= end_b:
                now[0].append(str(a[p]))
                p, at_a = p + 1, end_a
            if end_b <= end_a:
                now[1].append(str(b[q]))
                q, at_b = q + 1, end_b
            if end_a == end_b:
                groups.append("|".join(",".join(x) for x in now))
                now = ([], [])
        docs.append((key, len(a), len(b), groups, links))
    n = Counter(link for d in docs for link in d[4])
    high = defaultdict(int)
    for (_, b), k in n.items():
        high[b] = max(high[b], k)
    return Counter(
        (key, na, nb, len(g), len(ls), sum(n[x] == high[x[1]] for x in ls), sum(n[x] for x in ls),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for key, na, nb, g, ls in docs
    )


ODD = ["", None, "x", " ", "  a  b ", "▁a b", "<|endoftext|> <s> é\n\tq", "a" * 3000, "日本語 " * 300, "wörd \x85 \x1c z  ", "trail ",
       "a b " * 2000, "ab" * 900 + " " + "tail ing " * 300 + "▁", "thé quick-brown fox's 1234 " * 100, "\x00 null"]


@pytest.mark.parametrize("limits", [{}, {"long_bytes": 64, "range_bytes": 16, "fan_in": 2}, {"long_bytes": 500, "range_bytes": 37, "fan_in": 3, "sent_pairs": 20}, {"sent_pairs": 0}])
def test_alignment(spark, limits):
    texts = [*enumerate(ODD), (2, "x"), (None, "a b")]
    got = Counter(tuple(r) for r in alignment.alignments(_docs(spark, texts), A, B, **limits).collect())
    assert got == _plain_alignment(texts)
    assert alignment.alignments(_docs(spark, texts).limit(0), A, B, **limits).count() == 0


def test_alignment_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in LLM_QUERIES["op12_tokenizer_alignment"](spark, sf).collect()) == _plain_alignment(docs)


def test_fragments_compose_associatively():
    r = random.Random(4)

    for _ in range(400):
        size = r.randint(1, 30)
        ends = [sorted({size, *(r.randint(1, size) for _ in range(r.randint(0, 12)))}) for _ in "ab"]
        tokens = [[(i, e) for i, e in enumerate(side)] for side in ends]
        starts = [[0, *side[:-1]] for side in ends]
        cuts = sorted({0, *(r.randint(1, size) for _ in range(r.randint(0, 5)))})
        parts = []
        for low, high in zip(cuts, [*cuts[1:], size + 1]):
            fragment, groups = alignment.Fragment.of(*[[t for t, s in zip(ts, ss) if low <= s < high] for ts, ss in zip(tokens, starts)])
            parts.append((low, fragment, groups))

        def fold(low, high):
            """Composed in a random tree."""
            if high - low == 1:
                return parts[low][1]
            middle = r.randint(low + 1, high - 1)
            return fold(low, middle).then(fold(middle, high), parts[middle][0])

        plain, rest = alignment.Fragment.of(*tokens)
        for _ in range(3):
            whole = fold(0, len(parts))
            texts = [(2 * low + 1, ";".join(g)) for low, _, g in parts if g] + [(2 * at, text) for at, _, text in whole.joints]
            assert ";".join(t for _, t in sorted(texts)) == ";".join(rest)
            assert (whole.prefix_a, whole.prefix_b, whole.closed) == (plain.prefix_a, plain.prefix_b, True)
            assert not whole.suffix_a and not whole.suffix_b


# spelling


def _near(u, v):
    u, v = sorted((u, v), key=len)
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def test_composition_gives_each_pair_once():
    for seed in range(600):
        r = random.Random(seed)
        words = sorted({"".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 30))})
        got = [tuple(sorted(p)) for p in OneEdit(Acceptor(words)).pairs()]
        assert Counter(got) == Counter((u, v) for i, u in enumerate(words) for v in words[i + 1 :] if _near(u, v))


def test_acceptor_is_minimal():
    machine = Acceptor(sorted(a + b + c for a in "abc" for b in "abc" for c in "abc"))
    assert len(machine.steps) == 4


def _plain_variants(vocabulary, ratio=10):
    near = {w: [v for v in vocabulary if v != w and _near(v, w)] for w in vocabulary}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-vocabulary[v], v))
            if vocabulary[best] >= ratio * vocabulary[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), vocabulary.get(form.get(w))) for w, n in vocabulary.items()}


@pytest.mark.parametrize("limit", [8192, 3])
def test_variants(spark, limit):
    r = random.Random(limit)
    vocabulary = {"".join(r.choice("abÀé") for _ in range(r.randint(1, 6))): 10 ** r.randint(0, 5) + r.randint(0, 1) for _ in range(250)}
    vocabulary |= {"aaaaaaaaa": 3, "aaaaaaaaaa": 40, "aaaaaaaaaaa": 40, "xaaaaaaaaa": 40}
    words = spark.createDataFrame([(w, n, "b", 1) for w, n in vocabulary.items()], "word string, n long, begin string, rest long")
    got = [tuple(x) for x in spelling.variants(words, limit=limit).collect()]
    assert len(got) == len(vocabulary) and set(got) == _plain_variants(vocabulary)
    assert spelling.variants(words.limit(0), limit=limit).count() == 0


def _plain_vocabulary(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def test_vocabulary_and_query(spark, sf):
    texts = [(0, ""), (1, None), (None, "Variants variants VARIANTS"), (4, "Àéîõü×÷x Àéîõü×÷x"), (5, "sixsix seven12 seventh seventh"), (6, "longest" * 2000 + " " + "longest" * 2000)]
    texts += [(7, "repeated repeated"), (7, "repeated repeated")] + [(i, "spelling") for i in range(100, 200)]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(_docs(spark, texts)).collect()}
    assert got == _plain_vocabulary(texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    vocabulary = _plain_vocabulary(docs)
    rows = LLM_QUERIES["op13_spelling_variants"](spark, sf).collect()
    assert {(r["word"], r["n"]) for r in rows} == set(vocabulary.items()) and len(rows) == len(vocabulary)
    near = defaultdict(set)
    gaps = defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in vocabulary:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    for row in rows:
        best = min(near[row["word"]], key=lambda v: (-vocabulary[v], v), default=None)
        form = best if best and vocabulary[best] >= 10 * row["n"] else None
        assert (row["form"], row["n_near"], row["form_n"]) == (form, len(near[row["word"]]), vocabulary.get(form))
        assert (row["root"] == row["word"]) == (form is None)


def test_hot_beginnings_are_split(spark):
    """Many words of one beginning: no group of one task is larger than the limit."""
    words = {f"commonbeginning{i:04d}": 1 + (i % 7 == 0) * 20 for i in range(1200)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["near"]) for r in spelling.near_words(frame, limit=40).collect()}
    for w in random.Random(1).sample(sorted(words), 60):
        others = [v for v in words if v != w and _near(v, w)]
        assert got[w] == (len(others), min(others, key=lambda v: (-words[v], v)))
