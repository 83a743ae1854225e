"""Order-dependent greedy folds over one bounded array, as Spark expressions.

Packing that depends on where the current pack began cannot be a running sum:
``floor(total / limit)`` gives other cuts. ``F.aggregate`` walks the array in order
with the open pack in its state. The arrays come from a single row (one document,
one caption text); results grow by blocks, so a fold is close to linear in its items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` evaluated once, even where ``body`` uses it per element.

    A plain column used inside an array lambda is evaluated again for every element
    whenever the optimizer inlines its definition.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


BLOCK = 256


def growing_fold(items: Column, state: dict[str, Column], grown: str, kind: str,
                 step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """Fold ``items``; the result is the state's field ``grown``, an array of ``kind`` that
    ``step`` extends.

    A fold copies its state at every step, so an array that grows within it makes the
    whole quadratic. Here items are folded in blocks with an array that starts empty, and
    only whole blocks are added to the long one.
    """
    empty = F.array().cast(f"array<{kind}>")
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")

    def packed(fields: dict[str, Column]) -> Column:
        return F.struct(*(column.alias(name) for name, column in fields.items()))

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, packed({name: acc[name] for name in state} | {grown: empty}), lambda a, x: packed(step(a, x)))
        return let(inner, lambda one: packed({name: one[name] for name in state} | {grown: F.concat(acc[grown], one[grown])}))

    def folded(every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(every, k * BLOCK + 1, BLOCK))
        return F.aggregate(blocks, packed(state | {grown: empty}), block, lambda acc: acc[grown])

    return folded(items)


def pack_starts(items: Column, size: Callable[[Column], Column], at: Callable[[Column], Column],
                max_size: int, max_span: int | None, joiner: int = 0) -> Column:
    """Array of 1-based positions at which a new pack opens.

    A pack closes before an item that would take its size past ``max_size`` or that
    starts ``max_span`` or more after the pack's own start.
    """
    state = {"n": F.lit(0), "size": F.lit(0).cast("long"), "start": F.lit(0).cast("double")}

    def step(acc: Column, item: Column) -> dict[str, Column]:
        here = size(item).cast("long")
        over = acc["size"] + here > max_size
        if max_span is not None:
            over = over | (at(item) - acc["start"] >= max_span)
        opens = (acc["n"] == 0) | over
        return {
            "n": acc["n"] + 1,
            "size": F.when(opens, here).otherwise(acc["size"] + here + joiner),
            "start": F.when(opens, at(item).cast("double")).otherwise(acc["start"]),
            "cuts": F.when(opens, F.array_append(acc["cuts"], acc["n"] + 1)).otherwise(acc["cuts"]),
        }

    return growing_fold(items, state, "cuts", "int", step)


def take_while_fits(items: Column, size: Callable[[Column], Column], budget: Column | int) -> Column:
    """Length of the longest prefix whose sizes sum to at most ``budget``."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    state = F.struct(
        F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full")
    )

    def step(acc: Column, item: Column) -> Column:
        used = acc["used"] + size(item).cast("long")
        full = acc["full"] | (used > limit)
        return F.struct(
            F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, acc["used"]).otherwise(used).alias("used"),
            full.alias("full"),
        )

    return F.aggregate(items, state, step, lambda acc: acc["n"])
