"""Mixing sources to target weights by a budget that runs down a tree of domain, language and source.

A node's tokens are divided among its children by weight. A child that cannot use its part, since its
leaves have too few tokens even when repeated, leaves the rest to its siblings; only what a whole
subtree cannot use goes to the siblings of its ancestors. Each leaf then takes whole epochs and the
prefix of one more. An epoch's order is a hash of document, epoch and seed, so a prefix is all
documents up to some hash: it is found from sums over ranges of hashes, and rows are chosen by a
comparison, without sorting or moving texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.common import stored
from quillwork.llm.registry import llm_query
from quillwork.sources.tables import table

LEVELS = ("domain", "lang", "source")
#: Tokens to hand out, as a share of the tokens there are, and how often a document may be taken.
BUDGET_SHARE = 0.5
MAX_EPOCHS = 2
SEED = 17
#: Documents of a leaf in one range of hashes.
RANGE_ROWS = 2_000
#: Leaves of the tree; their sums are handled on the driver.
MAX_LEAVES = 1_000_000


def domain_of(source: Column, domains: int = 4) -> Column:
    """The domain that a source belongs to; a stand-in for a table that assigns them."""
    name = F.coalesce(source, F.lit(""))
    return F.concat(F.lit("domain"), F.pmod(F.crc32(name.cast("binary")), F.lit(domains)).cast("string"))


def divide(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Whole tokens for children (weight, capacity): by weight up to capacity, the rest to those with room.

    What rounding leaves goes one by one to the largest fractions, the earlier child first.
    """
    given = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = float(min(budget, sum(children[i][1] for i in open_)))
    target = int(left)
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] <= left * children[i][0] / total]
        if not full:
            for i in open_:
                given[i] = left * children[i][0] / total
            break
        for i in full:
            given[i] = float(children[i][1])
        left -= sum(given[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    whole = [min(int(g + 1e-9), c) for g, (_, c) in zip(given, children)]
    order = sorted(range(len(children)), key=lambda i: (whole[i] - given[i], i))
    rest = target - sum(whole)
    while rest > 0:
        took = False
        for i in order:
            if rest > 0 and whole[i] < children[i][1] and children[i][0] > 0:
                whole[i] += 1
                rest -= 1
                took = True
        if not took:
            break
    return whole


def budgets(leaves: dict[tuple, int], total: int, weights: dict[tuple, float], max_epochs: int) -> dict[tuple, int]:
    """Tokens for every leaf path. ``weights`` has a weight per path of any length; the default is 1."""
    capacity: dict[tuple, int] = {}
    below: dict[tuple, set] = {}
    for path, tokens in leaves.items():
        for depth in range(len(path) + 1):
            capacity[path[:depth]] = capacity.get(path[:depth], 0) + tokens * max_epochs
            if depth:
                below.setdefault(path[: depth - 1], set()).add(path[:depth])
    given = {(): min(total, capacity.get((), 0))}
    todo = [()]
    while todo:
        node = todo.pop()
        children = sorted(below.get(node, ()), key=lambda p: tuple((x is not None, x) for x in p))
        parts = divide(given[node], [(weights.get(c, 1.0), capacity[c]) for c in children])
        given.update(zip(children, parts))
        todo += children
    return {path: given[path] for path in leaves}


def _order(doc_id: str, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.col(doc_id), epoch.cast("int"), F.lit(seed))


def mix(
    docs: DataFrame, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, weights: dict[tuple, float] | None = None,
    seed: int = SEED, doc_id: str = "doc_id", text: str = "text", levels: tuple[str | Column, ...] = LEVELS, range_rows: int = RANGE_ROWS,
    epoch: str = "_epoch", tokens: str = "_tokens",
) -> DataFrame:
    """The chosen rows of ``docs`` with their ``epoch`` and ``tokens``, once per epoch that takes them.

    The levels of the tree are names or expressions over ``docs``. Columns of ``docs`` that have the names of the two new columns are
    replaced by these; other names cannot clash, as a row travels as one value.

    Tokens are runs without white space. A leaf's prefix ends with the document that reaches its
    budget, whole; rows of one doc_id are taken together. Null levels are a leaf of their own, null
    and empty texts have no tokens; a leaf without tokens is not taken. An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [f"_l{i}" for i in range(len(levels))]
    paths = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for n, c in zip(names, levels)]
    counted = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"), *paths,
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("_tokens"),
    )
    narrow = stored(counted.select("_id", *names, "_tokens"), "mix-counts")
    sums = narrow.groupBy(*names).agg(F.sum("_tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    leaves = {tuple(r[n] for n in names): r["t"] for r in sums}
    rows = {tuple(r[n] for n in names): r["n"] for r in sums}
    given = budgets(leaves, int(share * sum(leaves.values())), weights or {}, max_epochs)
    plan = [
        (*path, given[path] // tokens, given[path] % tokens, max(1, -(-rows[path] // range_rows)))
        for path, tokens in leaves.items() if tokens and given[path]
    ]
    kinds = ", ".join(f"{n} string" for n in names)
    budget = spark.createDataFrame(plan, f"{kinds}, _full int, _rest bigint, _ranges int")

    def same(left, right):
        out = F.lit(True)
        for n in names:
            out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
        return out

    # the prefix of the last epoch: sums by range of hashes, then rows of the one range that crosses the budget
    u = F.col("_u").cast("double") / 2.0**64 + 0.5
    last = (
        narrow.alias("d").join(F.broadcast(budget.where("_rest > 0")).alias("b"), same("d", "b"))
        .select(*[F.col(f"d.{n}") for n in names], "_tokens", "_rest", "_ranges", _order("_id", F.col("_full"), seed).alias("_u"))
        .withColumn("_range", F.least((u * F.col("_ranges")).cast("int"), F.col("_ranges") - 1))
    )
    leaf = Window.partitionBy(*names)
    until = Window.unboundedPreceding
    by_range = (
        last.groupBy(*names, "_range").agg(F.sum("_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
        .withColumn("_after", F.sum("_sum").over(leaf.orderBy("_range").rowsBetween(until, 0)))
        .where((F.col("_after") >= F.col("_rest")) & (F.col("_after") - F.col("_sum") < F.col("_rest")))
        .select(*names, F.col("_range").alias("_cross"), (F.col("_rest") - F.col("_after") + F.col("_sum")).alias("_need"))
    )
    units = (
        last.alias("d").join(F.broadcast(by_range).alias("r"), same("d", "r") & (F.col("_range") == F.col("_cross")))
        .groupBy(*[F.col(f"d.{n}") for n in names], "_u").agg(F.sum("_tokens").alias("_t"), F.first("_need").alias("_need"))
        .withColumn("_before", F.sum("_t").over(leaf.orderBy("_u").rowsBetween(until, 0)) - F.col("_t"))
        .where(F.col("_before") < F.col("_need"))
    )
    cuts = stored(units.groupBy(*names).agg(F.max("_u").alias("_cut")), "mix-cuts")
    chosen = (
        budget.alias("b").join(cuts.alias("c"), same("b", "c"), "left")
        .select(*[F.col(f"b.{n}").alias(n) for n in names], "_full", "_cut")
    )
    whole = F.when(F.col("_full") > 0, F.sequence(F.lit(0), F.col("_full") - 1)).otherwise(F.array().cast("array<int>"))
    part = F.when(_order("_id", F.col("_full"), seed) <= F.col("_cut"), F.array("_full")).otherwise(F.array().cast("array<int>"))
    taken = counted.alias("d").join(F.broadcast(chosen).alias("p"), same("d", "p")).select(
        "d._row", "d._tokens", F.explode(F.concat(whole, part)).alias("_epoch")
    )
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in (epoch, tokens)]
    return taken.select(*kept, F.col("_epoch").alias(epoch), F.col("_tokens").alias(tokens))


#: Target weights of the registered query: domains 4 to 1, inside each English twice as much as others, and
#: in the first domain German three times; whatever is not listed has weight 1.
WEIGHTS: dict[tuple, float] = {
    ("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0,
    **{(f"domain{d}", "en"): 2.0 for d in range(4)},
    ("domain0", "de"): 3.0,
}


@llm_query("op8_hierarchical_mix")
def op8_hierarchical_mix(spark, sf):
    """Half of all tokens, handed out by the weights of domain, then language, then source; documents at most twice."""
    docs = table(spark, sf, "documents").withColumn("domain", domain_of(F.col("source")))
    return mix(docs, weights=WEIGHTS).select(
        "doc_id", "domain", "lang", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens")
    )
