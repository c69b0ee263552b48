"""Regression, classification, clustering, recommendation and their metrics."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quillwork.operators import bayes
from quillwork.operators import learning as L
from quillwork.operators import metrics
from quillwork.operators import textfeatures as T
from quillwork.operators.features import stable_split, unit_deviation
from quillwork.operators.lookups import lookup_join
from quillwork.plans.features import SHARE
from quillwork.plans.text import TOKENS, kept_tokens_sql
from quillwork.registry import query
from quillwork.sources.tables import spread, table
from quillwork.sources.writers import write_fresh


def _items(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


_LINE = """fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
                          regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem)"""


@query(
    "ml_linear_regression",
    f"WITH {_LINE} SELECT round(slope, 3) AS coefficient, round(intercept, 2) AS intercept FROM fit",
)
def ml_linear_regression(spark, sf):
    model, _ = L.linear_model(_items(spark, sf), ["l_quantity"], "l_extendedprice")
    fit = [(float(model.coefficients[0]), float(model.intercept))]
    return spark.createDataFrame(fit, "coefficient double, intercept double").select(
        F.round("coefficient", 3).alias("coefficient"), F.round("intercept", 2).alias("intercept")
    )


def _line_scored(spark, sf):
    model, rows = L.linear_model(_items(spark, sf), ["l_quantity"], "l_extendedprice")
    return model.transform(rows)


@query(
    "ml_linear_residuals",
    f"""WITH {_LINE} SELECT l_orderkey, l_linenumber, round(l_extendedprice - (slope * l_quantity + intercept), 2) AS residual
        FROM lineitem, fit""",
)
def ml_linear_residuals(spark, sf):
    return _line_scored(spark, sf).select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - F.col("prediction"), 2).alias("residual")
    )


@query(
    "metric_regression",
    f"""WITH {_LINE}, s AS (SELECT l_extendedprice AS y, slope * l_quantity + intercept AS p FROM lineitem, fit)
        SELECT round(avg((y - p) * (y - p)), 1) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
               round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM s""",
)
def metric_regression(spark, sf):
    out = metrics.regression_metrics(_line_scored(spark, sf), "l_extendedprice", "prediction")
    return out.select(F.round("mse", 1).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


# Predictions by a fixed rule, so that the metric alone is compared.
_RULE = """WITH s AS (SELECT l.quality AS y, CASE WHEN d.n_chars > 400 AND d.lang <> 'de' THEN 1 ELSE 0 END AS p
                      FROM labels l JOIN documents d USING (doc_id))"""


def _rule_scored(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when((F.col("n_chars") > 400) & (F.col("lang") != "de"), 1.0).otherwise(0.0).alias("prediction")
    )
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return labels.join(docs, "doc_id")


@query(
    "metric_auc_hard",
    f"""{_RULE}, r AS (SELECT round((count(*) FILTER (WHERE y = 1 AND p = 1) * 1.0 / count(*) FILTER (WHERE y = 1)
                     + count(*) FILTER (WHERE y = 0 AND p = 0) * 1.0 / count(*) FILTER (WHERE y = 0)) / 2, 6) AS a FROM s)
        SELECT a AS auc_hard, a AS auc_by_evaluator FROM r""",
)
def metric_auc_hard(spark, sf):
    scored = _rule_scored(spark, sf)
    by_curve = BinaryClassificationEvaluator(rawPredictionCol="prediction").evaluate(scored)
    one = metrics.hard_auc(scored, "label", "prediction")
    return one.select(
        F.round("auc_hard", 6).alias("auc_hard"), F.round(F.lit(float(by_curve)), 6).alias("auc_by_evaluator")
    )


@query(
    "metric_accuracy",
    f"""{_RULE} SELECT round(avg(CAST(y = p AS INTEGER)), 6) AS accuracy,
                       round(1 - avg(CAST(y = p AS INTEGER)), 6) AS test_error FROM s""",
)
def metric_accuracy(spark, sf):
    out = metrics.accuracy(_rule_scored(spark, sf), "label", "prediction")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("test_error", 6).alias("test_error"))


@query(
    "metric_f1",
    f"""{_RULE}, c AS (SELECT k, count(*) FILTER (WHERE y = k) AS actual, count(*) FILTER (WHERE p = k) AS guessed,
                              count(*) FILTER (WHERE y = k AND p = k) AS tp
                       FROM s, (VALUES (0), (1)) v(k) GROUP BY k)
        SELECT round(sum(actual * 2.0 * tp / (actual + guessed)) / sum(actual), 6) AS f1 FROM c""",
)
def metric_f1(spark, sf):
    return metrics.weighted_f1(_rule_scored(spark, sf), "label", "prediction").select(F.round("f1", 6).alias("f1"))


@query(
    "metric_wssse",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS slot FROM embeddings),
            c AS (SELECT label, slot, avg(v) AS m FROM e GROUP BY 1, 2)
       SELECT round(sum((v - m) * (v - m)), 6) AS wssse FROM e JOIN c USING (label, slot)""",
)
def metric_wssse(spark, sf):
    points = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return metrics.within_set_squares(points, "vec_id", "embedding", "label").select(F.round("wssse", 6).alias("wssse"))


def _counts(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    return L.text_counts(docs, "text")


def _labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return labels.join(_counts(spark, sf), "doc_id")


def _parts(spark, sf):
    return stable_split(_labelled(spark, sf), "doc_id", 0.7, seed=L.SEED)


def _classified(spark, sf, kind):
    _, scored = L.classify(*_parts(spark, sf), kind, L.COUNTS, "label")
    return scored.select("doc_id", "label", "prediction")


@query("ml_logistic_regression")
def ml_logistic_regression(spark, sf):
    train, test = _parts(spark, sf)
    model, scored = L.classify(train, test, "logistic", L.COUNTS, "label")
    weights = dict(zip(L.COUNTS, (float(c) for c in model.coefficients)))
    rows = [(f"weight_{n}", w) for n, w in weights.items()]
    rows += [("intercept", float(model.intercept)), ("train_auc", float(model.summary.areaUnderROC))]
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability").evaluate(scored)
    rows += [("test_auc", float(auc)), ("test_accuracy", metrics.accuracy(scored, "label", "prediction").first()[0])]
    return spark.createDataFrame(rows, "name string, value double")


@query("ml_score_new_rows")
def ml_score_new_rows(spark, sf):
    # fitted on all labelled documents, then applied to those that have no label
    counts = _counts(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    fresh = counts.join(labels, "doc_id", "left_anti")
    _, scored = L.classify(labels.join(counts, "doc_id"), fresh, "logistic", L.COUNTS, "label")
    return scored.select("doc_id", "prediction", F.round(vector_to_array("probability")[1], 6).alias("probability"))


@query("ml_tree")
def ml_tree(spark, sf):
    return _classified(spark, sf, "tree")


@query("ml_forest")
def ml_forest(spark, sf):
    return _classified(spark, sf, "forest")


@query("ml_gbt")
def ml_gbt(spark, sf):
    return _classified(spark, sf, "gbt")


@query("ml_model_compare")
def ml_model_compare(spark, sf):
    return L.compare_models(*_parts(spark, sf), ["tree", "forest", "gbt"], L.COUNTS, "label")


@query("ml_feature_importance")
def ml_feature_importance(spark, sf):
    model, _ = L.classify(*_parts(spark, sf), "forest", L.COUNTS, "label")
    return L.importances(model, L.COUNTS)


@query(
    "ml_naive_bayes_text",
    f"""WITH d AS (SELECT doc_id, lang, length(text) AS size, {SHARE.format(seed=L.SEED)} < 0.7 AS train, {kept_tokens_sql()} AS kept
                   FROM (SELECT *, {TOKENS} AS t FROM documents)),
             words AS (SELECT doc_id, lang, train, unnest(kept) AS term FROM d),
             n AS (SELECT count(*) AS n, count(DISTINCT lang) AS k FROM d WHERE train),
             idf AS (SELECT term, ln(((SELECT n FROM n) + 1.0) / (count(DISTINCT doc_id) + 1.0)) AS idf FROM words WHERE train GROUP BY term),
             mass AS (SELECT term, lang, idf, count(*) * idf AS mass FROM words JOIN idf USING (term) WHERE train GROUP BY term, lang, idf),
             class AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS place,
                              ln(count(*) + 1.0) - ln((SELECT n + k FROM n)) AS prior, sum(size) AS size FROM d WHERE train GROUP BY lang),
             total AS (SELECT lang, sum(mass) AS mass FROM mass GROUP BY lang),
             whole AS (SELECT class.*, ln(total.mass + class.size + (SELECT count(*) + 1 FROM idf)) AS w
                       FROM class JOIN total USING (lang)),
             known AS (SELECT doc_id, sum(idf) AS known FROM words JOIN idf USING (term) WHERE NOT train GROUP BY doc_id),
             gain AS (SELECT doc_id, m.lang, sum(idf * ln(mass + 1)) AS gain
                      FROM words t JOIN mass m USING (term) WHERE NOT train GROUP BY doc_id, m.lang),
             score AS (SELECT d.doc_id, d.lang, c.place,
                              prior - coalesce(known, 0) * w + coalesce(gain, 0) + d.size * (ln(c.size + 1.0) - w) AS score
                       FROM d JOIN whole c ON NOT train LEFT JOIN known USING (doc_id)
                            LEFT JOIN gain g ON g.doc_id = d.doc_id AND g.lang = c.lang)
        SELECT doc_id, s.lang, CAST(coalesce(class.place, (SELECT k FROM n)) AS DOUBLE) AS label, CAST(s.place AS DOUBLE) AS prediction
        FROM score s LEFT JOIN class ON class.lang = s.lang
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s.place) = 1""",
)
def ml_naive_bayes_text(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    tokens = T.tokenize(docs.withColumn("length", F.length("text").cast("double")), "text").drop("text")
    cleaned = T.remove_stopwords(tokens, "tokens", "lang").drop("tokens")
    # fitted on the training part only, so the test part tells how well it does on new text
    train, test = stable_split(cleaned, "doc_id", 0.7, seed=L.SEED)
    model = bayes.fit(train, "kept", "lang", "length")
    best = bayes.predict(model, test, "doc_id", "kept", "length")
    place = F.coalesce(F.col("c.place").cast("double"), model.classes.agg(F.count(F.lit(1)).cast("double")).scalar())
    labelled = test.select("doc_id", "lang").join(model.classes.alias("c"), F.col("lang") == F.col("c.class"), "left")
    return labelled.select("doc_id", "lang", place.alias("label")).join(
        best.select("doc_id", F.col("place").cast("double").alias("prediction")), "doc_id"
    )


@query("ml_stage_chain")
def ml_stage_chain(spark, sf):
    train, test = _parts(spark, sf)
    with L.kept(train) as rows:
        model = L.category_classifier("lang", L.COUNTS, "label").fit(rows)
    return model.transform(test).select("doc_id", "label", "prediction")


def _points(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw")
    )
    return unit_deviation(vectors, "raw", "features").drop("raw")


def _clustered(spark, sf, k):
    points = _points(spark, sf)
    with L.kept(points) as cached:
        model = L.kmeans(cached, k)
    return model, model.transform(points)


@query("ml_kmeans")
def ml_kmeans(spark, sf):
    model, assigned = _clustered(spark, sf, 10)
    return L.centre_distance(assigned, model).select("vec_id", "prediction", F.round("distance2", 6).alias("distance2"))


@query("ml_kmeans_sizes")
def ml_kmeans_sizes(spark, sf):
    _, assigned = _clustered(spark, sf, 10)
    return assigned.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("ml_kmeans_sweep")
def ml_kmeans_sweep(spark, sf):
    return L.kmeans_sweep(_points(spark, sf), range(2, 9))


def _ratings(spark, sf):
    """``customer, part, rating`` from the mean quantity a customer orders of a part."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey")
    bought = lookup_join(items, orders, ["orderkey"], spread=["l_partkey", "l_quantity"], how="inner")
    ratings = bought.groupBy(
        F.col("o_custkey").cast("int").alias("customer"), F.col("l_partkey").cast("int").alias("part")
    ).agg((F.avg("l_quantity") / 10).alias("rating"))
    # every fit reads its ratings several times
    return spark.read.schema(ratings.schema).parquet(write_fresh(ratings, "ratings"))


@query("ml_als")
def ml_als(spark, sf):
    pair = F.concat_ws("-", "customer", "part")
    train, test = stable_split(_ratings(spark, sf).withColumn("pair", pair), "pair", 0.8, seed=L.SEED)
    model = L.als_model(train, "customer", "part", "rating")
    return model.transform(test).select("customer", "part", "rating", F.col("prediction").cast("double").alias("prediction"))


@query("ml_recommend_topk")
def ml_recommend_topk(spark, sf):
    known = _ratings(spark, sf)
    model = L.als_model(known, "customer", "part", "rating")
    first = known.agg(F.min("customer").alias("customer"))
    return L.recommend(model, spark.createDataFrame(first.collect(), first.schema), 3, "customer", "part")


@query("ml_fold_in_topk")
def ml_fold_in_topk(spark, sf):
    """Ratings of a customer the model has not seen come in, three parts go out: for every 50th customer."""
    known = _ratings(spark, sf)
    new = F.col("customer") % 50 == 0
    model = L.als_model(known.where(~new), "customer", "part", "rating")
    factors = L.fold_in(model, known.where(new), "customer", "part", "rating")
    return L.recommend_folded(model, factors, 3, "customer", "part")


def _lloyd_sql(clusters: int, steps: int) -> str:
    """Lloyd's rounds as one CTE after the other."""
    rounds = "".join(
        f""",
        g{i} AS (SELECT vec_id, place, sum((e.v - c.v) * (e.v - c.v)) AS d FROM e JOIN c{i} c USING (slot) GROUP BY vec_id, place),
        a{i} AS (SELECT vec_id, place, d FROM g{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, place) = 1),
        m{i} AS (SELECT place, slot, avg(v) AS v FROM a{i} JOIN e USING (vec_id) GROUP BY place, slot),
        c{i + 1} AS (SELECT place, slot, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (place, slot))"""
        for i in range(steps + 1)
    )
    return f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS slot FROM embeddings),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {clusters})),
        c0 AS (SELECT place, slot, v FROM s JOIN e USING (vec_id)){rounds}
        SELECT CAST(place AS INTEGER) AS place, count(*) AS n, round(sum(d), 4) AS cost, min(vec_id) AS first_vec, sum(vec_id)::BIGINT AS vec_sum
        FROM a{steps} GROUP BY place"""


@query("ml_kmeans_steps", _lloyd_sql(6, 4))
def ml_kmeans_steps(spark, sf, clusters=6, steps=4):
    """Sizes, cost and members of clusters after four rounds from the first six vectors."""
    points = table(spark, sf, "embeddings").select("vec_id", "embedding")
    start = [r["embedding"] for r in points.orderBy("vec_id").limit(clusters).collect()]
    placed = L.nearest_centre(points, "vec_id", "embedding", L.lloyd(points, "embedding", start, steps))
    return placed.groupBy("place").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("distance2"), 4).alias("cost"),
        F.min("vec_id").alias("first_vec"), F.sum("vec_id").alias("vec_sum"),
    )
