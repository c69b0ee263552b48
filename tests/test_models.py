"""Models: known fits, seeds, metrics against the library's evaluators, label-bearing text."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillwork.operators import bayes, learning, metrics
from quillwork.operators import textfeatures as T
from quillwork.plans import models
from quillwork.registry import QUERIES

ROWS_ONLY = [
    "feat_vector_index", "text_hashing_tf", "ml_logistic_regression", "ml_score_new_rows", "ml_tree", "ml_forest",
    "ml_gbt", "ml_model_compare", "ml_feature_importance", "ml_stage_chain", "ml_kmeans",
    "ml_kmeans_sizes", "ml_kmeans_sweep", "ml_als", "ml_recommend_topk", "ml_fold_in_topk",
]


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_gives_rows(spark, sf, key):
    assert QUERIES[key](spark, sf).count() > 0


def test_linear_fit_of_a_line(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x + 2.0) for x in range(50)], "x double, y double")
    model, _ = learning.linear_model(df, ["x"], "y")
    assert model.coefficients[0] == pytest.approx(3.0) and model.intercept == pytest.approx(2.0)


def test_metrics_equal_the_evaluators(spark):
    rows = [(float(i % 3), float((i * 7 % 11) % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    for name, got in [
        ("accuracy", metrics.accuracy(df, "label", "prediction").first()["accuracy"]),
        ("f1", metrics.weighted_f1(df, "label", "prediction").first()["f1"]),
    ]:
        assert got == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(df))
    got = metrics.regression_metrics(df, "label", "prediction").first()
    for name in ["mse", "rmse", "r2"]:
        assert got[name] == pytest.approx(RegressionEvaluator(metricName=name).evaluate(df))


def test_trees_find_the_deciding_feature(spark):
    rows = [(i, float(i % 10), float(i * 37 % 101), 1.0 if i * 37 % 101 > 50 else 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    for kind in ["tree", "forest", "gbt"]:
        model, scored = learning.classify(df, df, kind, ["a", "b"], "label")
        assert metrics.accuracy(scored, "label", "prediction").first()["accuracy"] > 0.95
        assert learning.importances(model, ["a", "b"]).orderBy("position").first().feature == "b"


def test_two_clusters(spark):
    points = [(i, Vectors.dense([0.1 * (i % 5), 0.0])) for i in range(20)]
    points += [(20 + i, Vectors.dense([9.0 + 0.1 * (i % 5), 9.0])) for i in range(20)]
    df = spark.createDataFrame(points, ["id", "features"])
    model = learning.kmeans(df, 2)
    assigned = learning.centre_distance(model.transform(df), model)
    assert Counter(Counter(r.prediction for r in assigned.collect()).values()) == {20: 2}
    assert assigned.agg(F.sum("distance2")).first()[0] == pytest.approx(model.summary.trainingCost)


def test_sweep_cost_falls(spark, sf):
    costs = [r.cost for r in QUERIES["ml_kmeans_sweep"](spark, sf).orderBy("k").collect()]
    assert len(costs) == 7 and costs[0] > costs[-1]


def test_ratings_without_ids_are_left_out(spark):
    rows = [(u, i, float((u * i) % 5)) for u in range(12) for i in range(8)] + [(None, 1, 3.0), (2, None, 1.0)]
    df = spark.createDataFrame(rows, "u int, i int, r double")
    model = learning.als_model(df, "u", "i", "r")
    top = learning.recommend(model, df.select("u").where("u = 3").distinct(), 3, "u", "i").orderBy("position").collect()
    assert [r.position for r in top] == [1, 2, 3] and top[0].score >= top[1].score >= top[2].score


def test_language_is_learnt_from_text(spark, sf):
    scored = QUERIES["ml_naive_bayes_text"](spark, sf)
    right = metrics.accuracy(scored, "label", "prediction").first()["accuracy"]
    shares = scored.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert right > max(shares, 0.8)


def test_same_seed_same_predictions(spark, sf):
    a, b = (sorted(map(tuple, QUERIES["ml_forest"](spark, sf).collect())) for _ in range(2))
    assert a == b


def test_term_in_every_document_weighs_nothing(spark):
    df = spark.createDataFrame([(1, ["all", "x"]), (2, ["all", "y", "y"]), (3, ["all"])], "id int, t array<string>")
    got = {(r.id, r.term): (r.tf, r.tfidf) for r in T.tfidf(df, "id", "t").collect()}
    assert all(got[i, "all"] == (1, 0.0) for i in (1, 2, 3))
    assert got[2, "y"][0] == 2 and got[2, "y"][1] == pytest.approx(2 * 0.6931471805599453)


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "id int, t array<string>")
    got = {r.id: r.ngrams for r in T.ngrams(df, "t", 2).collect()}
    assert got == {1: ["a b", "b c"], 2: [], 3: []}


def test_stop_words_follow_the_language(spark):
    df = spark.createDataFrame(
        [(1, "en", ["The", "dog"]), (2, "de", ["the", "und", "Hund"]), (3, "xx", ["the", "und"])],
        "id int, lang string, t array<string>",
    )
    got = {r.id: r.kept for r in T.remove_stopwords(df, "t", "lang").collect()}
    assert got == {1: ["dog"], 2: ["the", "Hund"], 3: ["the", "und"]}


def test_models_can_be_fitted_after_an_observed_write(spark, sf):
    assert QUERIES["ingest_metrics"](spark, sf).count() == 1
    assert QUERIES["ml_logistic_regression"](spark, sf).count() == 9
    assert QUERIES["ml_model_compare"](spark, sf).count() == 3


def _library_bayes(train, test):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer, VectorAssembler

    stages = [
        StringIndexer(inputCol="lang", outputCol="label", handleInvalid="keep"), CountVectorizer(inputCol="t", outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf"), VectorAssembler(inputCols=["tfidf", "size"], outputCol="features"), NaiveBayes(),
    ]
    return {r.id: r.prediction for r in Pipeline(stages=stages).fit(train).transform(test).collect()}


def test_bayes_tables_predict_as_the_library(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "de", "fr"])
        words = [rng.choice("abcdefgh") + rng.choice([lang, "x", "y"]) for _ in range(rng.randrange(12))]
        rows.append((i, lang, words, float(len(words)), "extra"))
    df = spark.createDataFrame(rows, "id long, lang string, t array<string>, size double, class string")
    train, test = df.where("id < 200"), df.where("id >= 200")
    model = bayes.fit(train, "t", "lang", "size")
    got = {r.id: float(r.place) for r in bayes.predict(model, test, "id", "t", "size").collect()}
    assert got == _library_bayes(train, test)
    assert model.classes.orderBy("place").first()["class"] == "en"


def test_bayes_edges(spark):
    schema = "id long, lang string, t array<string>, size double"
    rows = [(1, "a", ["x", "x"], 2.0), (2, "b", ["y"], 1.0), (3, None, ["z"], 1.0), (4, "b", [], 0.0)]
    model = bayes.fit(spark.createDataFrame(rows, schema), "t", "lang", "size")
    assert {r.term for r in model.terms.collect()} == {"x", "y"}
    asked = spark.createDataFrame([(1, None, ["x"] * 5, 0.0), (2, None, [], 0.0), (3, None, ["new"], 0.0), (4, None, None, 0.0)], schema)
    got = {r.id: r["class"] for r in bayes.predict(model, asked, "id", "t", "size").collect()}
    assert got == {1: "a", 2: "b", 3: "b", 4: "b"}  # without known words the more frequent class
    assert bayes.predict(model, asked.limit(0), "id", "t", "size").collect() == []


def test_bayes_model_has_no_largest_vocabulary(spark):
    """More terms than the library keeps by default, one of them decisive."""
    wide = spark.range(300_000).select(F.col("id"), F.lit("a").alias("lang"), F.array(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("t"), F.lit(1.0).alias("size"))
    b = spark.createDataFrame([(-1, "b", ["rare"], 1.0)], "id long, lang string, t array<string>, size double")
    model = bayes.fit(wide.unionByName(b), "t", "lang", "size")
    assert model.terms.count() == 300_001
    terms = {r.term: [w["class"] for w in r.weights] for r in model.terms.where("term IN ('rare', 't299999')").collect()}
    assert terms == {"rare": ["b"], "t299999": ["a"]}


def test_fold_in_solves_least_squares(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.choice([1.0, 2.0, 5.0])) for u in range(40) for i in range(25) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "u int, i int, r double")
    model = learning.als_model(df, "u", "i", "r")
    items = {r.id: np.array(r.features, dtype=float) for r in model.itemFactors.collect()}
    # users of the fit are solved in its last step, so folding them in gives them again
    users = {r.id: np.array(r.features) for r in model.userFactors.collect()}
    got = {r.u: np.array(r.factors) for r in learning.fold_in(model, df, "u", "i", "r").collect()}
    assert set(got) == set(users) and all(np.allclose(got[u], users[u], atol=2e-3) for u in users)
    new = [(900, 3, 5.0), (900, 7, 1.0), (900, 9, 4.0), (901, 999, 3.0), (902, 4, None), (None, 4, 2.0)]
    factors = learning.fold_in(model, spark.createDataFrame(new, "u int, i int, r double"), "u", "i", "r")
    v = np.stack([items[i] for i in (3, 7, 9)])
    want = np.linalg.solve(v.T @ v + 0.01 * 3 * np.eye(10), v.T @ np.array([5.0, 1.0, 4.0]))
    (only,) = factors.collect()
    assert only.u == 900 and np.allclose(only.factors, want)
    best = sorted(items, key=lambda i: (-float(items[i] @ want), i))[:3]
    for most in (1, 1000):
        top = learning.recommend_folded(model, factors, 3, "u", "i", most).orderBy("position").collect()
        assert [(r.u, r.position, r.i) for r in top] == [(900, p + 1, i) for p, i in enumerate(best)]
    assert learning.recommend_folded(model, factors.limit(0), 3, "u", "i").collect() == []


def test_lloyd_equals_the_plain_rounds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) + rng.integers(0, 3, size=(300, 1)) * 4
    start = [*x[:3].tolist(), [1e6] * 4]  # the last one never gets a point
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(300, None)], "id long, f array<double>").repartition(5)
    now = np.array(start)
    for _ in range(5):
        place = ((x[:, None] - now[None]) ** 2).sum(axis=2).argmin(axis=1)
        now = np.array([x[place == k].mean(axis=0) if (place == k).any() else now[k] for k in range(4)])
    got = learning.lloyd(df, "f", start, 5)
    assert np.allclose(got, now) and got[3].tolist() == [1e6] * 4
    assert {r.id: r.place for r in learning.nearest_centre(df, "id", "f", got).collect()} == dict(enumerate(((x[:, None] - now[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()))
    assert learning.lloyd(df.limit(0), "f", start, 2).tolist() == start


def test_vocabulary_options(spark):
    rows = [(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, ["b", "d", "d"]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    terms = [tuple(r) for r in T.vocabulary(df, "t", 3).orderBy("slot").collect()]
    assert terms == [("a", 0, 3, 2), ("b", 1, 2, 2), ("d", 2, 2, 1)]
    assert {r.term for r in T.vocabulary(df, "t", 10, min_df=0.4).collect()} == {"a", "b"}
    got = {(r.id, r.term): r.n for r in T.count_vectorize(df, "id", "t", 10, 1.0).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1, (2, "c"): 1, (3, "b"): 1, (3, "d"): 2}
    once = {(r.id, r.term): r.n for r in T.count_vectorize(df, "id", "t", 10, 1.0, binary=True).collect()}
    assert once == dict.fromkeys(got, 1)
    assert T.count_vectorize(df.limit(0), "id", "t", 10, 1.0).collect() == []


def test_best_items_equal_all_scores_and_ties_go_to_the_smaller_item(spark):
    rng = np.random.default_rng(3)
    items = (rng.normal(size=(5000, 4)) * rng.gamma(1, 1, size=(5000, 1))).round(1)
    ids, users = rng.permutation(5000), np.vstack([rng.normal(size=(300, 4)).round(1), np.zeros((1, 4))])
    items[:900] = items[100]  # many equal scores
    batches = [
        pa.RecordBatch.from_arrays([pa.array(ids[i : i + 700], pa.int32()), pa.array(list(items[i : i + 700]), pa.list_(pa.float32()))], names=["id", "f"])
        for i in range(0, 5000, 700)
    ]
    place, item, score = learning._best_items(users, batches, 3)
    scores = users @ items.astype(np.float32).astype(float).T
    for u in range(len(users)):
        wanted = np.lexsort((ids, -scores[u].round(9)))[:3]
        assert item[place == u].tolist() == ids[wanted].tolist() and np.allclose(score[place == u], scores[u][wanted])


def test_ratings_are_joined_once_and_read_from_files(spark, sf):
    plan = models._ratings(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Join" not in plan and "Aggregate" not in plan
