"""Summary tables: profiles, exact quartiles, correlations, class shares."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.positions import rows_at_ranks


def _long_rows(structs: list) -> F.Column:
    return F.explode(F.array(*structs)).alias("_r")


def describe_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum and maximum, one row per column, in one pass.

    Text columns have no mean; their extremes are given as text.
    """
    types = dict(df.dtypes)
    measures, rows = [], []
    for c in columns:
        text = types[c] == "string"
        parts = {
            "n": F.count(c),
            "mean": F.lit(None).cast("double") if text else F.avg(c),
            "stddev": F.lit(None).cast("double") if text else F.stddev_samp(c),
            "low": F.lit(None).cast("double") if text else F.min(c).cast("double"),
            "high": F.lit(None).cast("double") if text else F.max(c).cast("double"),
            "low_text": F.min(c) if text else F.lit(None).cast("string"),
            "high_text": F.max(c) if text else F.lit(None).cast("string"),
        }
        measures.append(F.struct(F.lit(c).alias("column_name"), *[v.alias(k) for k, v in parts.items()]).alias(f"_{c}"))
        rows.append(F.col(f"_{c}"))
    return df.agg(*measures).select(_long_rows(rows)).select("_r.*")


# Rank error of the sketches that bracket a quantile is at most 1 / this.
ACCURACY = 10_000


def _brackets(df: DataFrame, probes: list[dict], pad: float) -> None:
    """Set ``low`` and ``high`` of each probe: sketched values on both sides of its rank."""
    ends = {}
    for p in probes:
        ends.setdefault(p["column"], []).extend([max(p["share"] - pad, 0.0), min(p["share"] + pad, 1.0)])
    sketch = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, ACCURACY).alias(c) for c, shares in ends.items()]
    ).first()
    taken = {c: iter(sketch[c]) for c in ends}
    for p in probes:
        p["low"], p["high"] = next(taken[p["column"]]), next(taken[p["column"]])


def _count_sides(df: DataFrame, probes: list[dict]) -> None:
    """Set how many values lie ``below`` and ``inside`` each bracket, in one pass."""
    measures = []
    for i, p in enumerate(probes):
        v = F.col(p["column"]).cast("double")
        measures += [
            F.count_if(v < p["low"]).alias(f"below_{i}"),
            F.count_if((v >= p["low"]) & (v <= p["high"])).alias(f"inside_{i}"),
        ]
    counted = df.agg(*measures).first()
    for i, p in enumerate(probes):
        p["below"], p["inside"] = counted[f"below_{i}"], counted[f"inside_{i}"]


def _inside_counts(df: DataFrame, column: str, probes: list[dict]) -> DataFrame:
    """``probe, value, n``: how often each value inside a bracket of this column occurs."""

    def inside(v: Column, p: dict) -> Column:
        # NaN sorts after every number, so an open bracket ends there
        return (v >= p["low"]) & (v <= p["high"])

    mine = [(i, p) for i, p in enumerate(probes) if p["column"] == column]
    values = df.select(F.col(column).cast("double").alias("value"))
    near = values.where(reduce(or_, [inside(F.col("value"), p) for _, p in mine], F.lit(False)))
    counts = near.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # a value may lie in several brackets; this is done after counting, on few rows
    hits = F.filter(
        F.array(*[F.when(inside(F.col("value"), p), F.lit(i)) for i, p in mine]).cast("array<int>"),
        lambda i: i.isNotNull(),
    )
    return counts.select(F.explode(hits).alias("probe"), "value", "n")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Interpolated quantiles ``(column_name, share, value)``, exact for any size and distribution.

    A sketch of bounded size brackets every wanted rank; then only the values inside the brackets,
    a few in ten thousand, are counted and sorted. Equal values are counted first, so a value held
    by very many rows is one row. A bracket that misses its rank is opened to all values.
    """
    present = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    probes = []
    for c in columns:
        for share in shares if present[c] else []:
            at = (present[c] - 1) * share
            probes.append({"column": c, "share": share, "first": floor(at), "last": ceil(at), "at": at})
    result = "column_name string, share double, value double"
    if not probes:
        return df.sparkSession.createDataFrame([], result)
    _brackets(df, probes, 2 / ACCURACY)
    _count_sides(df, probes)
    for p in probes:
        if not p["below"] <= p["first"] <= p["last"] < p["below"] + p["inside"]:
            p["low"], p["high"], p["below"], p["inside"] = float("-inf"), float("nan"), 0, present[p["column"]]
    counts = reduce(DataFrame.unionByName, [_inside_counts(df, c, probes) for c in columns])
    ranks, base = [], 0
    for p in probes:
        start = base - p["below"]
        if p["first"] == p["last"]:
            weights = [(p["first"], 1.0)]
        else:
            weights = [(p["first"], p["last"] - p["at"]), (p["last"], p["at"] - p["first"])]
        ranks += [(p["column"], p["share"], start + rank, weight) for rank, weight in weights]
        base += p["inside"]
    met = rows_at_ranks(counts, ["probe", "value"], "n", [r[2] for r in ranks])
    plan = df.sparkSession.createDataFrame(
        ranks, "column_name string, share double, rank bigint, weight double"
    )
    # two ranks at most for each column and share
    return (
        met.join(F.broadcast(plan), "rank")
        .groupBy("column_name", "share")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    )


def describe_quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The profile of numeric columns with exact quartiles, one row per column."""
    profile = describe_long(df, columns).drop("low_text", "high_text")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("column_name").agg(
        *[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]]
    )
    return profile.join(wide, "column_name", "left").select(
        "column_name", "n", "mean", "stddev", "low", "q25", "q50", "q75", "high"
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairwise Pearson correlations in one pass, as ``(a, b, r)`` rows."""
    pairs = list(combinations(columns, 2)) + [(c, c) for c in columns]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = []
    for a, b in pairs:
        r = F.col(f"`{a}|{b}`").alias("r")
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r))
    return one.select(_long_rows(rows)).select("_r.*")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of every class."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(label, "n", (F.col("n") / total).alias("share"))
