"""Model metrics as one-row tables, each from a single aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.operators.lookups import lookup_join


def regression_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """``mse, rmse, r2`` in one pass."""
    error = F.col(label) - F.col(prediction)
    one = scored.agg(F.avg(error * error).alias("mse"), F.var_pop(label).alias("_var"))
    return one.select("mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "_var")).alias("r2"))


def hard_auc(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Area under the curve of 0/1 predictions, which is (TPR + TNR) / 2."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    one = scored.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(y).alias("positives"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y).alias("negatives"),
    )
    return one.select(
        ((F.try_divide("tp", "positives") + F.try_divide("tn", "negatives")) / 2).alias("auc_hard")
    )


def accuracy(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """``accuracy, test_error``."""
    right = F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0))
    return scored.agg(right.alias("accuracy")).withColumn("test_error", 1 - F.col("accuracy"))


def weighted_f1(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """F1 of every class weighted by its rows: the confusion counts, then sums over classes."""
    cells = scored.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    same = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"), same.alias("tp")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("tp")),
    )
    classes = cells.select(F.inline(sides)).groupBy("c").agg(
        F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("tp").alias("tp")
    )
    f1 = F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("guessed"))
    return classes.agg(F.try_divide(F.sum(F.col("actual") * f1), F.sum("actual")).alias("f1"))


def within_set_squares(points: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """Sum over all points of the squared distance to the mean of their cluster.

    Means are taken per cluster and slot, so a large cluster is summed on many tasks; what is joined
    back is one row per cluster, and a large cluster may meet it on many tasks.
    """
    slots = points.select(cluster, F.posexplode(vector).alias("slot", "v"))
    means = slots.groupBy(cluster, "slot").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = means.groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "m"))), lambda s: s["m"]).alias("centre")
    )
    gaps = F.zip_with(F.col(vector), F.col("centre"), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    cost = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)
    return lookup_join(points, centres, [cluster], spread=[key], how="inner").agg(F.sum(cost).alias("wssse"))
