"""Toxicity: a lexicon trie met with Levenshtein automata, and scores of the words around each hit.

The lexicon has a few general insults and what labelled documents teach: word beginnings and whole
words that are significantly more frequent in toxic ones. A word is run through the product of the
lexicon's trie and the automaton that allows one edit (made deterministic state by state, as words
need it), so misspelled terms are caught; signs inside a word and digits in place of letters are
undone first. A hit counts as quoted when quotation marks or a verb of reporting stand around it.
Sums over quoted and other hits go through logistic regression.

Labels come from a bounded sample. Its one part teaches the lexicon, its other part the regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.common import bounded_sample, fold, slices, stored, text_list
from quillwork.llm.registry import llm_query
from quillwork.sources.tables import table

#: Labelled documents that are learned from, drawn by hash of their id.
SAMPLE_DOCUMENTS = 8_000
#: Learned lexicon entries at most, the most significant first.
LEXICON_ENTRIES = 2_000
#: Least log-likelihood ratio of a learned entry.
SIGNIFICANCE = 20.0
#: Words before and behind a hit that decide whether it is quoted.
WINDOW = 6
#: Words whose result a worker keeps.
KEPT_WORDS = 500_000

# General insults known before any label is seen.
INSULTS = (
    "idiot moron stupid imbecile scum trash loser worthless pathetic disgusting clown dumbass bastard jerk "
    "retard pig vermin filth garbage fool"
).split()
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word term reads tweeted replied".split())
QUOTES = frozenset("\"“”„«»‹›")

_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")
_LEET = str.maketrans("013457@$", "oieastas")
_STEMS = (3, 4, 5, 6, 7, 8)


class Automaton:
    """The lexicon's trie met with one-edit automata, made deterministic as words walk through it.

    ``entries`` maps a term to its weight; a term ending in ``*`` is a word beginning. One edit is
    allowed in whole words of at least ``fuzzy`` letters, behind the first letter.
    """

    def __init__(self, entries: dict[str, float], fuzzy: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.begin: list[float] = [0.0]
        self.whole: list[float] = [0.0]
        self.near: list[float] = [0.0]
        self.edits: list[bool] = [False]
        for term, weight in sorted(entries.items()):
            stem, node = term.rstrip("*"), 0
            path = []
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.begin.append(0.0)
                    self.whole.append(0.0)
                    self.near.append(0.0)
                    self.edits.append(False)
                node = self.children[node][c]
                path.append(node)
            side = self.begin if term.endswith("*") else self.whole
            side[node] = max(side[node], weight)
            if side is self.whole and len(stem) >= fuzzy:
                self.near[node] = side[node]
                for n in path:
                    self.edits[n] = True
        self.fuzzy = fuzzy
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, members: set) -> int:
        grown, todo = set(members), list(members)
        while todo:  # a letter of the term may be missing in the word
            node, errors = todo.pop()
            if errors == 0 and node and self.edits[node]:
                for child in self.children[node].values():
                    if self.edits[child] and (child, 1) not in grown:
                        grown.add((child, 1))
        key = frozenset(m for m in grown if m[1] == 0 or (m[0], 0) not in grown)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, errors in self.members[state]:
            child = self.children[node].get(c)
            if child is not None and (errors == 0 or self.edits[child]):
                out.add((child, errors))
            if errors == 0 and node and self.edits[node]:
                out.add((node, 1))
                out.update((n, 1) for n in self.children[node].values() if self.edits[n])
        after = self._state(out)
        self.steps[state][c] = after
        return after

    def match(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best term in ``word``; weight 0 where there is none."""
        if len(self.members) > 50_000:  # forgets states that odd words made
            self.states, self.members, self.steps = {}, [], []
            self.start = self._state({(0, 0)})
        state, best = self.start, 0.0
        for c in word:
            after = self.steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if not self.members[state]:
                return best, 0
            best = max(best, max((self.begin[n] for n, e in self.members[state] if e == 0), default=0.0))
        exact = max((self.whole[n] for n, e in self.members[state] if e == 0), default=0.0)
        if max(exact, best) > 0:
            return max(exact, best), 0
        if len(word) >= self.fuzzy - 1:
            near = max((self.near[n] for n, e in self.members[state] if e == 1), default=0.0)
            return near, int(near > 0)
        return 0.0, 0


def _stems(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in _STEMS if len(word) >= k)]


class Scorer:
    """Weights and automaton as learned; a copy goes to every task."""

    def __init__(self, entries: dict[str, float], weights: np.ndarray, ordinary: frozenset[str] = frozenset()):
        self.entries, self.weights, self.ordinary = entries, weights, ordinary
        self.automaton: Automaton | None = None
        self.kept: dict[str, tuple[float, int] | bool] = {}

    def _word(self, token: str):
        word = _EDGE.sub("", token)
        weight, edits = self.automaton.match(word) if word else (0.0, 0)
        if not weight and not word.isalpha() and len(word) < 64:
            for form in (_INNER.sub("", word), _INNER.sub("", word.translate(_LEET))):
                if form.isalpha() and not weight:
                    weight, edits = self.automaton.match(form)
                    edits = 1
        hit = (weight, edits, word) if weight > 0 and not (edits and word in self.ordinary) else False
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        self.kept[token] = hit
        return hit

    def features(self, text: str) -> list[float]:
        if self.automaton is None:
            self.automaton = Automaton(self.entries)
        tokens = text.lower().split()
        hits = list(map(self.kept.get, tokens))
        plain, quoted, fuzzy, best, words = 0.0, 0.0, 0, 0.0, set()
        for i, hit in enumerate(hits):
            if hit is None:
                hit = self._word(tokens[i])
            if hit:
                weight, edits, word = hit
                around = tokens[max(0, i - WINDOW) : i], tokens[i : i + WINDOW]
                marks = [any(c in QUOTES for w in side for c in w) for side in around]
                if all(marks) or not REPORTING.isdisjoint(around[0]):
                    quoted += weight
                else:
                    plain += weight
                    best = max(best, weight)
                fuzzy += edits
                words.add(word)
        size = math.log1p(len(tokens))
        return [1.0, math.log1p(plain), math.log1p(quoted), best, float(min(len(words), 10)),
                math.log1p(plain) / (1 + size), math.log1p(fuzzy), size / 10]

    def score(self, text: str) -> float:
        margin = float(np.dot(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


#: Used where no labels teach others: hits outside quotations decide.
PRIOR = np.array([-3.0, 1.5, 0.2, 0.6, 0.5, 2.0, -0.1, 0.0])


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression drawn towards PRIOR."""
    def loss(w):
        margin = x @ w
        return float((np.logaddexp(0, margin) - y * margin).sum() + 0.15 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - 0.3 * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = SAMPLE_DOCUMENTS) -> Scorer:
    """Lexicon and regression from at most ``documents`` labelled documents outside the held-out fold.

    ``labels`` has ``doc_id`` and ``toxic``; null labels are left out, repeated ones count as toxic if
    one is. Without labels, the general insults and PRIOR remain.
    """
    seen = (
        labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 0))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    )
    chosen = seen.join(bounded_sample(seen, "_id", documents), "_id")
    rows = stored(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .select("_text", "_y", (F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(3)) == 0).alias("_second")),
        "toxic-sample",
    )

    def count(batches):
        schema = pa.schema([("stem", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])
        for batch in slices(batches, 256):
            bad, good = Counter(), Counter()
            for body, y in zip(text_list(batch.column(0)), batch.column(1).to_pylist()):
                words = {_EDGE.sub("", t) for t in set(body.lower().split())}
                stems = {s for w in words if 2 < len(w) < 64 for s in _stems(w)}
                (bad if y == 1 else good).update(stems)
            keys = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()),
                 pa.array([good[k] for k in keys], pa.int64())], schema=schema)

    first = rows.where(~F.col("_second"))
    totals = {r["_y"] == 1: r["n"] for r in first.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = totals.get(True, 0), totals.get(False, 0)
    entries, ordinary = {w: 2.0 for w in INSULTS}, frozenset()
    if n_bad and n_good:
        share = n_bad / (n_bad + n_good)
        bad, good, both = F.col("bad"), F.col("good"), F.col("bad") + F.col("good")
        ratio = 2 * (
            bad * F.log(bad / (both * share))
            + F.when(good > 0, good * F.log(good / (both * (1 - share)))).otherwise(0.0)
        )
        stems = stored(
            first.select("_text", "_y").mapInArrow(count, "stem string, bad long, good long")
            .groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")),
            "toxic-stems",
        )
        learned = (
            stems.where((bad >= 3) & (bad / n_bad > 3 * good / n_good) & (ratio >= SIGNIFICANCE))
            .orderBy(ratio.desc(), "stem").limit(LEXICON_ENTRIES).collect()
        )
        found = {
            r["stem"]: math.log((r["bad"] + 0.5) / (n_bad + 1)) - math.log((r["good"] + 0.5) / (n_good + 1))
            for r in learned
        }
        # a longer beginning that weighs no more than a shorter one adds nothing; a whole word adds its misspelled forms
        for term, weight in found.items():
            stem = term.rstrip("*")
            if term == stem or not any(found.get(f"{stem[:k]}*", 0) >= weight for k in _STEMS if k < len(stem)):
                entries[term] = max(weight, entries.get(term, 0.0))
        # one edit from a learned word, and no rarer in other documents than in toxic ones: a word of its own
        taught = {t: w for t, w in entries.items() if t not in INSULTS and not t.endswith("*")}

        def near(batches):
            new, known = Automaton(taught), Automaton({w: 2.0 for w in INSULTS})
            for batch in batches:
                words = batch.column(0).to_pylist()
                yield batch.filter(pa.array([new.match(w)[1] > 0 and not known.match(w)[0] for w in words], pa.bool_()))

        if taught:
            usual = stems.where(~F.col("stem").endswith("*") & (good / n_good >= bad / n_bad)).select("stem")
            ordinary = frozenset(r["stem"] for r in usual.mapInArrow(near, "stem string").collect())
    scorer = Scorer(entries, PRIOR, ordinary)

    def describe(batches):
        schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
        for batch in slices(batches):
            x = [scorer.features(t) for t in text_list(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(x, schema.field(1).type)], schema=schema)

    second = rows.where("_second").select("_text", "_y").mapInArrow(describe, "y int, x array<double>").toPandas()
    y = (second["y"].to_numpy() == 1).astype(float)
    if 0 < y.sum() < len(y):
        scorer = Scorer(entries, _regression(np.array(second["x"].tolist()), y), ordinary)
    return scorer


def toxicity(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row. Null and empty texts get the score of a text without hits;
    repeated rows are scored each; an empty table gives no rows."""

    def score(batches):
        for batch in slices(batches):
            out = [scorer.score(t) for t in text_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(score, "doc_id long, score double")


def keep_civil(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, unchanged."""
    place = docs.columns.index(text)

    def keep(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in text_list(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


@llm_query("op3_toxicity")
def op3_toxicity(spark, sf):
    """A toxicity score for every document."""
    docs = table(spark, sf, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
