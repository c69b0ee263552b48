"""Text features on token arrays and as long tables."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.stopwords import STOP_WORDS
from quillwork.operators.lookups import lookup_join
from quillwork.operators.positions import with_position
from quillwork.sources.storage import durable
from quillwork.sources.writers import write_fresh


def tokenize(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Lower-case words between single white-space characters."""
    return Tokenizer(inputCol=text, outputCol=out).transform(df)


def regex_tokenize(df: DataFrame, text: str, pattern: str, gaps: bool = True, out: str = "tokens") -> DataFrame:
    """Lower-case words: what lies between matches of the pattern, or the matches themselves."""
    return RegexTokenizer(inputCol=text, outputCol=out, pattern=pattern, gaps=gaps).transform(df)


def remove_stopwords(df: DataFrame, tokens: str, lang: str, out: str = "kept") -> DataFrame:
    """Drop the stop words of each row's own language, in one pass over the rows.

    Every language has its own remover; a row of another language reaches it as an empty array.
    Rows of a language without a list keep all tokens.
    """
    none = F.array().cast("array<string>")
    parts = {code: (f"_in_{code}", f"_out_{code}") for code in STOP_WORDS}
    staged = df.withColumns(
        {i: F.when(F.col(lang) == code, F.col(tokens)).otherwise(none) for code, (i, _) in parts.items()}
    )
    for code, (i, o) in parts.items():
        staged = StopWordsRemover(inputCol=i, outputCol=o, stopWords=STOP_WORDS[code]).transform(staged)
    other = F.when(F.coalesce(F.col(lang), F.lit("")).isin(*STOP_WORDS), none).otherwise(F.col(tokens))
    kept = F.concat(*[F.col(o) for _, o in parts.values()], other)
    return staged.select(*df.columns, kept.alias(out))


def ngrams(df: DataFrame, tokens: str, n: int = 2, out: str = "ngrams") -> DataFrame:
    return NGram(n=n, inputCol=tokens, outputCol=out).transform(df)


def hashing_tf(df: DataFrame, tokens: str, features: int = 20, out: str = "tf") -> DataFrame:
    return HashingTF(inputCol=tokens, outputCol=out, numFeatures=features).transform(df)


def tfidf(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key, term, tf, df, tfidf`` with idf = ln((documents + 1) / (df + 1)).

    Postings are counted before anything else is shuffled; rows that lie together by ``key`` are counted where they lie.
    The document frequencies are joined back by ``lookup_join``: a term found in very many documents is cut over several tasks.
    """
    # an inner explode would compute the tokens a second time, to test them for emptiness
    terms = df.select(key, F.explode_outer(tokens).alias("term")).where(F.col("term").isNotNull())
    postings = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    postings = df.sparkSession.read.schema(postings.schema).parquet(write_fresh(postings, "postings"))
    frequencies = durable(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    documents = df.count()
    joined = lookup_join(
        postings, frequencies, ["term"], spread=[key], how="inner", counts=frequencies.withColumnRenamed("df", "_n")
    )
    idf = F.log((F.lit(documents) + 1.0) / (F.col("df") + 1.0))
    return joined.select(key, "term", "tf", "df", (F.col("tf") * idf).alias("tfidf"))


def vocabulary(df: DataFrame, tokens: str, size: int, min_df: float = 1.0) -> DataFrame:
    """``term, slot, n, df``: the ``size`` most frequent terms found in ``min_df`` rows or more, as a table.

    ``n`` counts occurrences, ``df`` rows; a ``min_df`` under 1 is a share of all rows. Slots go by falling ``n``, ties by the
    term. Terms are counted by one shuffle and numbered by a range sort, so no task and not the
    driver holds the vocabulary, however large.
    """
    both = F.concat(
        F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("df"))),
    )
    marks = df.select(F.explode_outer(both).alias("m")).select("m.*").where("term IS NOT NULL")
    counts = marks.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    least = F.lit(min_df) if min_df >= 1 else df.agg(F.count(F.lit(1)) * min_df).scalar()
    ranked = with_position(counts.where(F.col("df") >= least).withColumn("_fall", -F.col("n")), ["_fall", "term"], "slot")
    return ranked.where(F.col("slot") < size).select("term", "slot", "n", "df")


def count_terms(df: DataFrame, key: str, tokens: str, terms: DataFrame, binary: bool = False) -> DataFrame:
    """``key, term, slot, n``: the non-empty slots of each row; with ``binary`` every n is 1."""
    words = df.select(key, F.explode_outer(F.array_distinct(tokens) if binary else F.col(tokens)).alias("term")).where("term IS NOT NULL")
    met = lookup_join(words, terms.select("term", "slot"), ["term"], spread=[key], how="inner")
    return met.groupBy(key, "term", "slot").agg(F.count(F.lit(1)).alias("n"))


def count_vectorize(df: DataFrame, key: str, tokens: str, vocabulary_size: int, min_df: float, binary: bool = False) -> DataFrame:
    """``key, term, slot, n`` for the most frequent terms, by :func:`vocabulary` and :func:`count_terms`."""
    return count_terms(df, key, tokens, durable(vocabulary(df, tokens, vocabulary_size, min_df)), binary)
