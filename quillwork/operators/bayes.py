"""Multinomial naive Bayes over texts whose model is two tables, so neither vocabulary nor weights pass the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.operators.lookups import lookup_join
from quillwork.sources.storage import durable


@dataclass
class TextBayes:
    """``terms``: term, idf, weights (class, weight of the class beyond that of a term it never had).

    ``classes``: class, place (0 for the most frequent), prior, unseen (weight of a term the class never
    had), size (weight of the extra feature).
    """

    terms: DataFrame
    classes: DataFrame


def fit(rows: DataFrame, tokens: str, label: str, size: str, smoothing: float = 1.0) -> TextBayes:
    """Count terms by class in one shuffle of (term, class) sums.

    Features are term counts times ln((documents + 1) / (documents with the term + 1)), and ``size``, a
    non-negative number of each row. All terms are features. Rows without a class teach nothing.
    """
    known = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("class"), tokens, F.col(size).alias("size"))
    # every occurrence counts once for the frequency, and once a row for the documents
    occurrences = known.select("class", F.explode_outer(tokens).alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))
    documents_with = known.select("class", F.explode_outer(F.array_distinct(tokens)).alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    marks = occurrences.unionByName(documents_with).where("term IS NOT NULL")
    counts = durable(marks.groupBy("term", "class").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))
    per_class = known.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    totals = per_class.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    documents, kinds = totals["n"] or 0, totals["k"]
    idf = F.log((F.lit(documents) + 1.0) / (F.sum("df") + 1.0))
    one = F.lit(smoothing)
    gathered = counts.groupBy("term").agg(idf.alias("idf"), F.collect_list(F.struct("class", "tf")).alias("all"))
    terms = durable(
        gathered.select(
            "term", "idf",
            F.transform("all", lambda c: F.struct(c["class"].alias("class"), F.log1p(c["tf"] * F.col("idf") / one).alias("weight"))).alias("weights"),
            F.transform("all", lambda c: F.struct(c["class"].alias("class"), (c["tf"] * F.col("idf")).alias("mass"))).alias("masses"),
        )
    )
    features = terms.count() + 1
    mass = terms.select(F.inline("masses")).groupBy("class").agg(F.sum("mass").alias("mass"))
    whole = F.log(F.coalesce("mass", F.lit(0.0)) + F.col("size") + features * one)
    ranked = per_class.join(mass, "class", "left").select(
        "class", "n",
        (F.log(F.col("n") + one) - F.log(F.lit(documents) + kinds * one)).alias("prior"),
        (F.log(one) - whole).alias("unseen"),
        (F.log(F.col("size") + one) - whole).alias("size"),
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "class", "prior", "unseen", "size")))
    placed = ranked.agg(order.alias("c")).select(F.posexplode("c").alias("place", "c"))
    return TextBayes(terms.drop("masses"), durable(placed.select("c.class", "place", "c.prior", "c.unseen", "c.size")))


def predict(model: TextBayes, rows: DataFrame, key: str, tokens: str, size: str) -> DataFrame:
    """``key, class, place`` of the best class of each row; terms the model never saw say nothing.

    A tie goes to the class of the smaller place. ``key`` is unique.
    """
    # equal words of a row are counted before they meet the model
    words = rows.select(key, F.explode_outer(tokens).alias("term")).where("term IS NOT NULL")
    counted = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    met = lookup_join(counted, model.terms, ["term"], spread=[key], how="inner")
    # the entry without a class adds up what all known words weigh
    every = F.concat("weights", F.array(F.struct(F.lit(None).cast(model.classes.schema["class"].dataType).alias("class"), F.lit(1.0).alias("weight"))))
    parts = met.select(key, (F.col("tf") * F.col("idf")).alias("mass"), F.explode(every).alias("w"))
    sums = parts.groupBy(key, F.col("w.class").alias("class")).agg(F.sum(F.col("mass") * F.col("w.weight")).alias("gain"))
    gathered = sums.groupBy(key).agg(
        F.max(F.when(F.col("class").isNull(), F.col("gain"))).alias("known"),
        F.map_from_entries(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "gain")))).alias("gains"),
    )
    classes = model.classes.agg(F.array_sort(F.collect_list(F.struct("place", "class", "prior", "unseen", "size"))).alias("c"))
    scored = rows.select(key, F.col(size).alias("_size")).join(gathered, key, "left").withColumn("_classes", classes.scalar())
    known = F.coalesce("known", F.lit(0.0))

    def score(c):
        gain = F.coalesce(F.try_element_at("gains", c["class"]), F.lit(0.0))
        total = c["prior"] + known * c["unseen"] + gain + F.col("_size") * c["size"]
        return F.struct((-total).alias("loss"), c["place"].alias("place"), c["class"].alias("class"))

    best = F.array_min(F.transform("_classes", score))
    return scored.select(key, best.alias("best")).select(key, F.col("best.class").alias("class"), F.col("best.place").alias("place"))
