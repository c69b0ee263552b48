"""Tokens, stop words, n-grams, term frequencies."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillwork.functions.stopwords import STOP_WORDS
from quillwork.operators import textfeatures as T
from quillwork.registry import query
from quillwork.sources.tables import spread, table

# white space only at the end gives no token, inner white space gives empty tokens
TOKENS = r"string_split_regex(regexp_replace(lower(text), '\s+$', ''), '\s')"


def _documents(spark, sf, *extra):
    return spread(table(spark, sf, "documents").select("doc_id", "text", *extra), "doc_id")


def _tokens(spark, sf, *extra):
    return T.tokenize(_documents(spark, sf, *extra), "text").drop("text")


def _joined(tokens):
    return F.array_join(tokens, "|")


@query(
    "text_tokenize",
    f"""SELECT doc_id, array_to_string(t, '|') AS tokens, CAST(len(t) AS INTEGER) AS n_tokens
        FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
)
def text_tokenize(spark, sf):
    return _tokens(spark, sf).select("doc_id", _joined("tokens").alias("tokens"), F.size("tokens").alias("n_tokens"))


@query(
    "text_regex_tokenize",
    r"""SELECT doc_id, array_to_string([x for x in string_split_regex(lower(text), '[^a-zA-Z0-9_]') if x <> ''], '|') AS words,
               CAST(len(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS INTEGER) AS n_matches
        FROM documents""",
)
def text_regex_tokenize(spark, sf):
    words = T.regex_tokenize(_documents(spark, sf), "text", r"\W", out="words")
    both = T.regex_tokenize(words, "text", r"\w+", gaps=False, out="matches")
    return both.select("doc_id", _joined("words").alias("words"), F.size("matches").alias("n_matches"))


def kept_tokens_sql(tokens: str = "t") -> str:
    """The tokens of a row without the stop words of its language."""

    def quoted(words):
        return ", ".join("'" + w.replace("'", "''") + "'" for w in words)

    kept = " ".join(
        f"WHEN '{code}' THEN [x for x in {tokens} if x NOT IN ({quoted(words)})]" for code, words in STOP_WORDS.items()
    )
    return f"CASE lang {kept} ELSE {tokens} END"


def _stopword_sql() -> str:
    return f"""SELECT doc_id, array_to_string({kept_tokens_sql()}, '|') AS kept
               FROM (SELECT doc_id, lang, {TOKENS} AS t FROM documents)"""


@query("text_stopwords", _stopword_sql())
def text_stopwords(spark, sf):
    kept = T.remove_stopwords(_tokens(spark, sf, "lang"), "tokens", "lang")
    return kept.select("doc_id", _joined("kept").alias("kept"))


@query(
    "text_ngrams",
    f"""SELECT doc_id, array_to_string([t[i] || ' ' || t[i + 1] for i in range(1, len(t))], '|') AS bigrams
        FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
)
def text_ngrams(spark, sf):
    return T.ngrams(_tokens(spark, sf), "tokens", 2).select("doc_id", _joined("ngrams").alias("bigrams"))


@query("text_hashing_tf")
def text_hashing_tf(spark, sf):
    hashed = T.hashing_tf(_tokens(spark, sf), "tokens", 20)
    return hashed.select("doc_id", vector_to_array("tf").alias("tf"))


@query(
    "text_tfidf",
    f"""WITH p AS (SELECT doc_id, term, count(*) AS tf
                   FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2),
             d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
        SELECT doc_id, term, tf, df,
               round(tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)), 6) AS tfidf
        FROM p JOIN d USING (term)""",
)
def text_tfidf(spark, sf):
    # texts are dealt by document before they are cut, as they are smaller than their words
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return T.tfidf(T.tokenize(docs, "text").drop("text"), "doc_id", "tokens").withColumn("tfidf", F.round("tfidf", 6))


@query(
    "text_count_vectorize",
    f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
             v AS (SELECT term FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2
                   ORDER BY count(*) DESC, term LIMIT 20)
        SELECT doc_id, term, count(*) AS n FROM t WHERE term IN (SELECT term FROM v) GROUP BY 1, 2""",
)
def text_count_vectorize(spark, sf):
    return T.count_vectorize(_tokens(spark, sf), "doc_id", "tokens", 20, min_df=2.0).select("doc_id", "term", "n")


@query(
    "text_vocabulary_wide",
    f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
             v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS slot FROM t GROUP BY term
                   HAVING count(DISTINCT doc_id) >= (SELECT count(*) * 0.0015 FROM documents))
        SELECT DISTINCT doc_id, term, slot, 1::BIGINT AS n FROM t JOIN v USING (term) WHERE slot < 100000""",
)
def text_vocabulary_wide(spark, sf):
    """Which of the 100,000 most frequent terms, found in 0.15 % of all documents or more, each document has."""
    return T.count_vectorize(_tokens(spark, sf), "doc_id", "tokens", 100_000, min_df=0.0015, binary=True)
