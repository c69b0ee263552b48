"""Spelling variants: words one edit apart, found by composing the vocabulary with itself over one edit.

The composed machine is dealt out by the state it starts in. A beginning with few words is one start
state: its words become a minimised acceptor, which is composed with the one-edit transducer and with
itself again inside a task. A beginning with many words is left by one letter: the pairs whose edit is at
that very letter are in states whose sides differ already, and these read the same rest, so they are
dealt by beginning and rest; pairs with a later edit go on to the longer beginnings. So no task holds more than
``limit`` words of one beginning, and a beginning and rest belong to no more words than there are letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.acceptors import Acceptor, OneEdit
from quillwork.llm.common import stored
from quillwork.llm.registry import llm_query
from quillwork.operators.lookups import lookup_join
from quillwork.sources.storage import fresh_path
from quillwork.sources.tables import table

#: Words of one beginning that become one acceptor; some 10 MB of Python objects.
GROUP_WORDS = 8192
#: A form must occur so many times as often as its variant.
RATIO = 10
#: One of so many hashes of a document and a word loses a letter.
ERRORS_IN = 31

_NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEAR = "word string, n_near long, near_n long, near string"


def letter_runs(text: Column, least: int) -> Column:
    """Maximal runs of letters with ``least`` of them or more, A-Z made lower case; null has none."""
    runs = F.filter(F.split(F.coalesce(text, F.lit("")), _NOT_LETTERS), lambda w: F.length(w) >= least)
    return F.transform(runs, lambda w: F.when(F.rlike(w, F.lit("[A-Z]")), F.translate(w, _UPPER, _LOWER)).otherwise(w))


def with_errors(key: Column, run: Column, one_in: int = ERRORS_IN) -> Column:
    """``run`` without one letter where ``one_in`` divides the crc32 of key and run; a null key is empty text."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("bigint")).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % one_in == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = 7, least_count: int = 2, one_in: int = ERRORS_IN) -> DataFrame:
    """``word, n`` of the words of all whole texts with so many letters and occurrences."""
    runs = docs.select(F.col("doc_id").alias("key"), F.explode(letter_runs(F.col("text"), least_letters)).alias("run"))
    words = runs.select(with_errors(F.col("key"), F.col("run"), one_in).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (beginning, word, n): for each word that has near words in its group their number and the best."""

    def settle(begin: str, counts: dict[str, int]) -> list[tuple]:
        best: dict[str, list] = {}
        size = len(begin)
        machine = OneEdit(Acceptor([w[size:] for w in counts]))
        for u, v in machine.pairs(begin[-1:]):
            u, v = begin + u, begin + v
            for word, other in ((u, v), (v, u)):
                seen = best.get(word)
                new = (-counts[other], other)
                if seen is None:
                    best[word] = [1, new]
                else:
                    seen[0] += 1
                    if new < seen[1]:
                        seen[1] = new
        return [(w, k, -n, other) for w, (k, (n, other)) in best.items()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        words, counts, ns, near = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(ns, pa.int64()), pa.array(near, pa.string())],
            names=["word", "n_near", "near_n", "near"],
        )

    begin, counts = None, {}
    for part in batches:
        for p, word, n in zip(*(c.to_pylist() for c in part.columns)):
            if p != begin:
                if len(counts) > 1 and (rows := settle(begin, counts)):
                    yield batch(rows)
                begin, counts = p, {}
            counts[word] = n
    if len(counts) > 1 and (rows := settle(begin, counts)):
        yield batch(rows)


def _near_at_letter(edges: DataFrame) -> DataFrame:
    """Near words of groups of one beginning and rest: those with a letter between them, and the one without.

    ``letter`` is null for the word without one. Words with a letter differ from each other by a
    replaced one; the word without differs by an inserted one unless ``repeats``, when the same
    insertion is found farther left.
    """
    groups = edges.groupBy("begin", "rest").agg(F.collect_list(F.struct("letter", "repeats", "word", "n")).alias("all")).where(F.size("all") > 1)
    one = groups.select("all", F.explode("all").alias("me"))

    def near(me: Column, other: Column) -> Column:
        both = me["letter"].isNotNull() & other["letter"].isNotNull() & (me["letter"] != other["letter"])
        inserted = (me["letter"].isNull() != other["letter"].isNull()) & ~F.coalesce(me["repeats"], other["repeats"])
        return both | inserted

    found = one.select(
        F.col("me.word").alias("word"),
        F.transform(F.filter("all", lambda o: near(F.col("me"), o)), lambda o: F.struct((-o["n"]).alias("n"), o["word"].alias("word"))).alias("near"),
    ).where(F.size("near") > 0)
    return found.select(
        "word", F.size("near").cast("bigint").alias("n_near"),
        (-F.array_min("near")["n"]).alias("near_n"), F.array_min("near")["word"].alias("near"),
    )


def near_words(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, near_n, near`` for each word that has others exactly one edit away.

    ``words`` has distinct words and their counts (word, n). An edit inserts, deletes or replaces one
    code point. ``near`` is the near word of largest n, of those the smallest in code-point order.
    The driver sees one number a letter of the longest crowded beginning.
    """
    spark = words.sparkSession
    leaf_path, edge_path = fresh_path(spark, "llm-spelling-groups"), fresh_path(spark, "llm-spelling-edges")
    active, depth = words.select("word", "n"), 0
    while True:
        keyed = active.withColumn("begin", F.substring("word", 1, depth))
        crowded = stored(keyed.groupBy("begin").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > limit).select("begin"), "spelling-crowded")
        if crowded.isEmpty():
            keyed.select("begin", "word", "n").write.mode("append").parquet(leaf_path)
            break
        marked = lookup_join(keyed, crowded.withColumn("on", F.lit(True)), ["begin"], spread=["word"])
        marked = stored(marked, "spelling-level")
        marked.where("on IS NULL").select("begin", "word", "n").write.mode("append").parquet(leaf_path)
        on = marked.where("on")
        rest, letter = F.substr("word", F.lit(depth + 1)), F.substring("word", depth + 1, 1)
        before = F.substring("word", depth, 1) if depth else F.lit("")
        without = on.select("begin", rest.alias("rest"), F.lit(None).cast("string").alias("letter"), F.lit(None).cast("boolean").alias("repeats"), "word", "n")
        with_ = on.where(F.length("word") > depth).select(
            "begin", F.substr("word", F.lit(depth + 2)).alias("rest"), letter.alias("letter"), (letter == before).alias("repeats"), "word", "n"
        )
        without.unionByName(with_).write.mode("append").parquet(edge_path)
        active, depth = on.where(F.length("word") > depth).select("word", "n"), depth + 1
    leaves = spark.read.schema("begin string, word string, n long").parquet(leaf_path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = leaves.repartition(parts, "begin").sortWithinPartitions("begin", "word").mapInArrow(_near_in_groups, _NEAR)
    if depth:
        found = found.unionByName(_near_at_letter(spark.read.parquet(edge_path)))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return (
        found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))
    )


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root``: each word followed along its ``form`` to the last one; every round doubles the way gone."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = stored(
            lookup_join(ways, onward, ["root"], spread=["word"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-ways",
        )
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = GROUP_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a vocabulary (word, n).

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's own, else null; ``root`` is where the forms lead, the word itself without one.
    As n grows by ``ratio`` a step, forms cannot lead back.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    near = near_words(words, limit)
    rated = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near")).alias("form"),
            F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_n")).alias("form_n"),
        ),
        "spelling-rated",
    )
    roots = roots_of(rated.where("form IS NOT NULL"))
    return rated.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@llm_query("op13_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words of all documents; rows of null doc_id hash an empty id, null texts have no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(vocabulary(docs))
