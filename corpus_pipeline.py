"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Toxic documents go; of each group of near-copies one document stays; personal data are masked; sources
are mixed to even weights; what is left is packed into sequences. Every stage but the last returns the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import jaccard, mixing, packing, private, toxic
from quillwork.llm.common import free_name, small_batches, stored
from quillwork.operators.positions import with_position
from quillwork.sources.tables import table

#: Tokens that the mix hands out, as a share of those left, and how often it may take a document.
MIX_SHARE = 1.0
MIX_EPOCHS = 2
#: Pieces whose ids a packing worker remembers: it has run the other stages before and keeps their memory.
PACKING_PIECES = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half."""
    with small_batches(spark):  # holds for jobs that run inside, so the texts are written here
        scorer = toxic.fit(docs, table(spark, sf_dir, "labels"))
        return stored(toxic.keep_civil(docs, scorer), "stage-toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles have a similarity of 0.8 or more: the smallest doc_id.

    Of rows that agree in doc_id and text one stays. Rows that share a doc_id with other texts are documents of
    their own, of which the smaller text counts as the smaller. Documents without words link with
    nothing and stay, as do all rows without doc_id.
    """
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    shared = stored(shared, "shared-ids")
    if shared.isEmpty():
        groups = jaccard.jaccard_components(docs, width=5, percent=80)
        gone = groups.where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # numbers in the order of doc_id and text take the place of ids that are not unique
    row, key, text = (free_name(docs, n) for n in ("row", "key", "text_hash"))
    whole = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    packed = stored(whole.select("doc_id", "text", F.xxhash64("text").alias(text), F.struct(*[F.col(c) for c in docs.columns]).alias(row)), "documents")
    numbered = with_position(packed.select("doc_id", "text"), ["doc_id", "text"], key)
    keyed = stored(packed.join(numbered, (packed["doc_id"] == numbered["doc_id"]) & packed["text"].eqNullSafe(numbered["text"])).select(packed["text"], row, key), "documents")
    groups = jaccard.jaccard_components(keyed, width=5, percent=80, doc_id=key)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key))
    left = keyed.join(gone, key, "left_anti").select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return left.unionByName(docs.where("doc_id IS NULL"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by their kind; ``n_chars`` follows the text."""
    with small_batches(spark):
        masked = stored(private.redact(docs, private.fit(docs)), "stage-private_data")
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by even weights of domain, language and source; a row per epoch that takes one."""
    epoch, tokens = free_name(docs, "epoch"), free_name(docs, "tokens")
    levels = (mixing.domain_of(F.col("source")), "lang", "source")
    mixed = mixing.mix(docs, MIX_SHARE, MIX_EPOCHS, levels=levels, epoch=epoch, tokens=tokens)
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place there."""
    return packing.pack_documents(docs, kept=PACKING_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("private_data", mask_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages that have written their rows when they return.
WRITTEN = ("toxicity", "private_data")

# Learned scores, group joins and tokenizers have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = stored(docs, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
