"""Fitting, scoring and comparing models. Every random step has a seed."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.operators.features import assemble
from quillwork.operators.lookups import lookup_join
from quillwork.operators.metrics import accuracy, weighted_f1

SEED = 42
# Ratings of a block of users or items, which one task holds as arrays.
RATINGS_A_BLOCK = 3_000_000
COUNTS = ["n_chars", "n_words", "n_lines", "n_digits", "n_marks"]


@contextmanager
def kept(df: DataFrame):
    """Keep a table that an iterative fit reads again and again, for as long as it does."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def text_counts(docs: DataFrame, text: str) -> DataFrame:
    """Replace the text by counts of what is in it, so that no text travels through later joins."""
    return docs.withColumns(
        {
            "n_chars": F.length(text).cast("double"),
            "n_words": F.size(F.split(text, r"\s+")).cast("double"),
            "n_lines": F.size(F.split(text, "\n")).cast("double"),
            "n_digits": F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double"),
            "n_marks": F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\s]", "")).cast("double"),
        }
    ).drop(text)


def linear_model(df: DataFrame, features: list[str], label: str):
    """Least squares without regularisation; the normal equations are summed in one pass."""
    rows = assemble(df, features)
    return LinearRegression(labelCol=label, solver="normal").fit(rows), rows


CLASSIFIERS = {
    "tree": lambda label: DecisionTreeClassifier(labelCol=label, seed=SEED),
    "forest": lambda label: RandomForestClassifier(labelCol=label, numTrees=20, seed=SEED),
    "gbt": lambda label: GBTClassifier(labelCol=label, maxIter=10, seed=SEED),
    "logistic": lambda label: LogisticRegression(labelCol=label),
}


def classify(train: DataFrame, test: DataFrame, kind: str, features: list[str], label: str):
    """Fit one classifier; returns the model and the scored test rows."""
    with kept(assemble(train, features)) as rows:
        model = CLASSIFIERS[kind](label).fit(rows)
    return model, model.transform(assemble(test, features))


def compare_models(train: DataFrame, test: DataFrame, kinds: list[str], features: list[str], label: str) -> DataFrame:
    """``model, accuracy, test_error, f1, auc`` rows: each kind fitted and scored on the same parts."""
    session, rows = train.sparkSession, []
    with kept(assemble(train, features)) as fit_on, kept(assemble(test, features)) as score_on:
        for kind in kinds:
            scored = CLASSIFIERS[kind](label).fit(fit_on).transform(score_on)
            a = accuracy(scored, label, "prediction").first()
            f1 = weighted_f1(scored, label, "prediction").first()["f1"]
            auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability").evaluate(scored)
            rows.append((kind, a["accuracy"], a["test_error"], f1, auc))
    return session.createDataFrame(rows, "model string, accuracy double, test_error double, f1 double, auc double")


def importances(model, features: list[str]) -> DataFrame:
    """``feature, importance, position``, most important first; one row per feature."""
    session = SparkSession.active()
    ranked = sorted(zip(features, model.featureImportances.toArray()), key=lambda r: (-r[1], r[0]))
    rows = [(name, float(value), place) for place, (name, value) in enumerate(ranked, 1)]
    return session.createDataFrame(rows, "feature string, importance double, position int")


def category_classifier(category: str, numbers: list[str], label: str) -> Pipeline:
    """Index and encode a category, assemble it with numbers, logistic regression."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=category, outputCol=f"{category}_index", handleInvalid="keep"),
            OneHotEncoder(inputCol=f"{category}_index", outputCol=f"{category}_slots"),
            VectorAssembler(inputCols=[f"{category}_slots", *numbers], outputCol="features"),
            LogisticRegression(labelCol=label),
        ]
    )


def _lloyd_sums(centres: np.ndarray, key: str | None, features: str):
    """For a stream of batches the squared distance to and the place of the nearest centre; summed by place, or by row."""

    def nearest(batches):
        n, sums, cost = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack(batch.column(batch.schema.get_field_index(features)).to_numpy(zero_copy_only=False)).astype(float)
            gaps = np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)
            place = gaps.argmin(axis=1)
            least = gaps[np.arange(len(rows)), place]
            if key is not None:
                columns = [batch.column(batch.schema.get_field_index(key)), pa.array(place, pa.int32()), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "place", "distance2"])
                continue
            np.add.at(n, place, 1)
            np.add.at(sums, place, rows)
            np.add.at(cost, place, least)
        if key is None:
            columns = [pa.array(range(len(centres)), pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.float64())), pa.array(cost)]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "n", "sums", "cost"])

    return nearest


def lloyd(points: DataFrame, features: str, centres: list[list[float]], steps: int) -> np.ndarray:
    """Centres after ``steps`` rounds from the given ones. A centre without points stays; ties go to the smaller place.

    Each task sums its points by centre, and the sums are added by Spark: the driver sees one number a centre and
    dimension, whatever the points. Rows without features take no part.
    """
    now = np.array(centres, dtype=float)
    rows = points.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias(features))
    with kept(rows) as rows:
        for _ in range(steps):
            parts = rows.mapInArrow(_lloyd_sums(now, None, features), "place int, n double, sums array<double>, cost double")
            flat = parts.where("n > 0").select("place", "n", F.posexplode("sums").alias("slot", "v"))
            for r in flat.groupBy("place", "slot").agg((F.sum("v") / F.sum("n")).alias("mean")).collect():
                now[r["place"], r["slot"]] = r["mean"]
    return now


def nearest_centre(points: DataFrame, key: str, features: str, centres: np.ndarray) -> DataFrame:
    """``key, place, distance2`` of every row with features."""
    rows = points.where(F.col(features).isNotNull()).select(key, F.col(features).cast("array<double>").alias(features))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_lloyd_sums(np.asarray(centres, dtype=float), key, features), f"{key} {kind}, place int, distance2 double")


def kmeans(points: DataFrame, k: int, features: str = "features", seed: int = 1):
    return KMeans(k=k, seed=seed, featuresCol=features).fit(points)


def centre_distance(assigned: DataFrame, model, features: str = "features") -> DataFrame:
    """Add the squared distance of every point to its cluster's centre; centres are plan constants."""
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    gaps = F.zip_with(vector_to_array(features), F.get(centres, F.col("prediction")), lambda a, b: (a - b) * (a - b))
    return assigned.withColumn("distance2", F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g))


def kmeans_sweep(points: DataFrame, ks: range, features: str = "features") -> DataFrame:
    """``k, cost`` for every k, over points that stay cached for the sweep."""
    with kept(points) as cached:
        rows = [(k, float(kmeans(cached, k, features).summary.trainingCost)) for k in ks]
    return points.sparkSession.createDataFrame(rows, "k int, cost double")


def als_model(ratings: DataFrame, user: str, item: str, rating: str):
    """Explicit-feedback factors; rows without an id cannot be placed and are left out first.

    The fit reads its ratings more than once, so they should be stored. Ten blocks of users and of items, and more
    when a block would hold over ``RATINGS_A_BLOCK`` ratings.
    """
    known = ratings.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    blocks = max(10, known.count() // RATINGS_A_BLOCK)
    als = ALS(
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        maxIter=5,
        regParam=0.01,
        userCol=user,
        itemCol=item,
        ratingCol=rating,
        coldStartStrategy="drop",
        seed=SEED,
    )
    return als.fit(known)


def recommend(model, users: DataFrame, k: int, user: str, item: str) -> DataFrame:
    """``user, position, item, score``: the ``k`` best items of each given user."""
    lists = model.recommendForUserSubset(users, k)
    picks = lists.select(user, F.posexplode("recommendations").alias("position", "pick"))
    return picks.select(user, (F.col("position") + 1).alias("position"), f"pick.{item}", F.col("pick.rating").alias("score"))


def fold_in(model, ratings: DataFrame, user: str, item: str, rating: str, regularisation: float = 0.01) -> DataFrame:
    """``user, factors``: least-squares factors of users the model was not fitted with, from their ratings.

    Solves (sum of v v' + regularisation * n * 1) u = sum of rating * v over the n rated items, whose factors v stay as
    they are: what the fit itself does for a user in its last step. Ratings of unknown items say nothing; a
    user without others has no row.
    """
    items = model.itemFactors.select(F.col("id").alias(item), F.col("features").cast("array<double>").alias("_v"))
    rated = ratings.where(F.col(user).isNotNull() & F.col(rating).isNotNull()).select(user, item, F.col(rating).cast("double").alias("_r"))
    met = lookup_join(rated, items, [item], spread=[user], how="inner")
    rank = model.rank
    v = [F.col("_v")[i] for i in range(rank)]
    sums = met.groupBy(user).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.sum(v[i] * v[j]) for i in range(rank) for j in range(rank)]).alias("_a"),
        F.array(*[F.sum(F.col("_r") * v[i]) for i in range(rank)]).alias("_b"),
    )

    def solve(batches):
        for batch in batches:
            users, n, a, b = batch.columns
            left = np.array(a.to_pylist(), dtype=float).reshape(-1, rank, rank)
            left += regularisation * n.to_numpy(zero_copy_only=False)[:, None, None] * np.eye(rank)
            solved = np.linalg.solve(left, np.array(b.to_pylist(), dtype=float).reshape(-1, rank, 1))[:, :, 0]
            yield pa.RecordBatch.from_arrays([users, pa.array(list(solved), pa.list_(pa.float64()))], names=[user, "factors"])

    return sums.mapInArrow(solve, f"{user} {ratings.schema[user].dataType.simpleString()}, factors array<double>")


# Users and items whose scores are one array: it stays in the processor's cache.
_USERS, _ITEMS = 256, 2048


def _best_items(users: np.ndarray, batches, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of users, items and scores: the ``k`` best of all items in Arrow batches of ``id, features``, ties to the smaller item.

    No score exceeds the product of the lengths of both vectors, so items, longest first, are multiplied only with the
    users whose ``k``-th best score is not above that.
    """
    lengths = np.linalg.norm(users, axis=1)
    least = np.full(len(users), -np.inf)  # the k-th best score so far
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def merge(found):
        place, item, score = (np.concatenate(c) for c in zip(best, *found))
        order = np.lexsort((item, -score, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        now = place, item[order], score[order]
        full = rank == k - 1
        least[place[full]] = now[2][full]
        return tuple(c[rank < k] for c in now)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(float)
        norms = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-norms, kind="stable")
        ids, vectors, norms = ids[order], vectors[order], norms[order]
        for at in range(0, len(ids), _ITEMS):
            block, names = vectors[at : at + _ITEMS], ids[at : at + _ITEMS]
            open_ = np.flatnonzero(lengths * norms[at] * (1 + 1e-9) >= least)
            found = []
            for start in range(0, len(open_), _USERS):
                places = open_[start : start + _USERS]
                scores = users[places] @ block.T
                bound = least[places]
                if len(names) > k and np.isneginf(bound).any():
                    bound = np.maximum(bound, np.partition(scores, -k, axis=1)[:, -k])
                u, i = np.nonzero(scores >= bound[:, None])
                found.append((places[u], names[i], scores[u, i]))
            if found:
                best = merge(found)
    return best


def recommend_folded(model, factors: DataFrame, k: int, user: str, item: str, most_users: int = 20_000) -> DataFrame:
    """``user, position, item, score``: the ``k`` best items of users with folded-in factors.

    The users asked about, ``most_users`` at a time, go to the items: each task gives its ``k`` best for every user.
    Every item counts; those that cannot be among the best by their length are not multiplied.
    """
    session = factors.sparkSession
    asked = factors.orderBy(user).toArrow()
    id_type, kind = asked.schema.field(user).type, factors.schema[user].dataType.simpleString()
    out = None
    for start in range(0, asked.num_rows, most_users):
        part = asked.slice(start, most_users)
        ids, vectors = part.column(user).to_numpy(), np.array(part.column("factors").to_pylist())

        def best(batches, ids=ids, vectors=vectors):
            places, found, values = _best_items(vectors, batches, k)
            for at in range(0, len(places), 10_000):
                columns = (ids[places[at : at + 10_000]], id_type), (found[at : at + 10_000], pa.int32()), (values[at : at + 10_000], pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=[user, item, "score"])

        met = model.itemFactors.mapInArrow(best, f"{user} {kind}, {item} int, score double")
        out = met if out is None else out.unionByName(met)
    if out is None:
        return session.createDataFrame([], f"{user} {kind}, position int, {item} int, score double")
    ranked = out.withColumn("position", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), item)))
    return ranked.where(F.col("position") <= k).select(user, "position", item, "score")
