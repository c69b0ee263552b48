"""Array expressions that stay linear in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used inside a lambda may be evaluated again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def tail(items: Column, skip: int = 1) -> Column:
    """``items`` without its first ``skip`` elements."""
    return F.slice(items, F.lit(skip + 1), F.size(items))


def scan(
    items: Column,
    carry: Column,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column, Column]],
) -> Column:
    """Walk ``items`` in order with a running ``carry`` and gather what the steps give out.

    ``step(carry, item)`` returns the next carry, an output of type ``out_type`` and whether to keep
    it. Outputs are gathered in blocks, because appending to one growing array would copy it at
    every step.
    """
    none = F.array().cast(f"array<{out_type}>")

    def inner(state: Column, item: Column) -> Column:
        after, out, keep = step(state["carry"], item)
        kept = F.when(keep, F.array_append(state["out"], out)).otherwise(state["out"])
        return F.struct(after.alias("carry"), kept.alias("out"))

    def outer(state: Column, block: Column) -> Column:
        now = F.struct(state["now"]["carry"].alias("carry"), none.alias("out"))
        return F.struct(
            F.aggregate(block, now, inner).alias("now"),
            F.array_append(state["done"], state["now"]["out"]).alias("done"),
        )

    def walk(bound: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / _BLOCK).cast("int")),
            lambda b: F.slice(bound, b * _BLOCK + 1, _BLOCK),
        )
        start = F.struct(
            F.struct(carry.alias("carry"), none.alias("out")).alias("now"),
            F.array().cast(f"array<array<{out_type}>>").alias("done"),
        )
        return F.aggregate(
            blocks, start, outer, lambda s: F.flatten(F.array_append(s["done"], s["now"]["out"]))
        )

    return let(items, lambda bound: F.when(F.size(bound) > 0, walk(bound)).otherwise(none))


def prefix_sums(numbers: Column) -> Column:
    """Sum of each element and all before it.

    Each round adds the value twice as far back as the round before, so the work grows with
    n log n and nothing is appended to.
    """

    def walk(bound: Column) -> Column:
        exponents = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bound))).cast("int"))
        steps = F.transform(exponents, lambda e: F.pow(F.lit(2), e).cast("int"))
        return F.aggregate(
            steps,
            bound,
            lambda sums, k: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - k), F.lit(0))),
        )

    return let(numbers, lambda bound: F.when(F.size(bound) > 1, walk(bound)).otherwise(bound))


def run_starts(items: Column, differs: Callable[[Column, Column], Column]) -> Column:
    """Indexes at which a run of equal neighbours begins; ``items`` must be a bound variable."""
    indexes = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(indexes, lambda i: (i == 0) | differs(F.get(items, i), F.get(items, F.greatest(i - 1, F.lit(0)))))


def runs(items: Column, differs: Callable, build: Callable[[Column, Column], Column]) -> Column:
    """One ``build(first element, run)`` per run of equal neighbours; ``items`` must be bound."""
    return let(
        run_starts(items, differs),
        lambda starts: F.transform(
            starts,
            lambda at, k: build(
                F.get(items, at),
                F.slice(items, at + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - at),
            ),
        ),
    )
