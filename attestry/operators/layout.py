"""OCR boxes to clean items, and reading hints from their positions.

A frame keeps its first 30 items, so the items of a frame fit one row and positions
are compared inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fold import let
from ..functions.text import strip


def _mean(corners: Column, axis: str) -> Column:
    total = F.aggregate(corners, F.lit(0.0), lambda acc, c: acc + c[axis])
    return F.bround(total / F.size(corners), 1)


def ocr_normalize(boxes: DataFrame, keys: list[str], *, most: int | None = None,
                  min_confidence: float = P.OCR_CONFIDENCE) -> DataFrame:
    """(keys, pos, text, confidence, corners) → the confident items with centres, all or the first ``most``."""
    clean = boxes.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter(
        (F.col("text") != "") & (F.col("confidence") >= min_confidence)
    )
    # The rows that are sorted for their numbers hold no corners.
    narrow = clean.select(
        *keys, "pos", "text",
        F.bround("confidence", 3).alias("confidence"),
        _mean(F.col("corners"), "x").alias("x"),
        _mean(F.col("corners"), "y").alias("y"),
    )
    placed = narrow.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("pos")))
    first = placed if most is None else placed.filter(F.col("n") <= most)
    return first.select(*keys, "n", "pos", "text", "confidence", "x", "y")


def _items(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("n", "text", "x", "y"))).alias("items")
    )


def _pairs(items: Column) -> Column:
    """``label ↔ number`` for every label with a number above it within 90 pixels."""
    numbers = F.filter(items, lambda i: i["text"].rlike(P.OCR_NUMBER))
    labels = F.filter(items, lambda i: i["text"].rlike(P.OCR_LABEL))

    def pair(label: Column, every: Column) -> Column:
        above = F.filter(
            every, lambda num: (num["y"] < label["y"]) & (F.abs(num["x"] - label["x"]) <= 90)
        )
        cost = lambda num: F.abs(num["x"] - label["x"]) + F.abs(num["y"] - label["y"]) * 0.1
        best = F.array_min(
            F.transform(above, lambda num: F.struct(cost(num).alias("c"), num["n"].alias("n"), num["text"].alias("t")))
        )
        return F.concat(label["text"], F.lit(" ↔ "), best["t"])

    return let(numbers, lambda every: F.array_compact(F.transform(labels, lambda label: pair(label, every))))


def _row(items: Column) -> Column:
    """Texts of the longest line of upper-case labels, left to right."""
    steps = F.filter(
        items,
        lambda i: i["text"].rlike(P.OCR_STEP)
        & (F.length(F.regexp_replace(i["text"], "[^A-Z]", "")) >= 4)
        & ~i["text"].rlike(P.OCR_NUMBER),
    )

    def line(seed: Column, every: Column) -> Column:
        same = F.filter(every, lambda i: F.abs(i["y"] - seed["y"]) <= 35)
        by_x = F.sort_array(F.transform(same, lambda i: F.struct(i["x"].alias("x"), i["n"].alias("n"), i["text"].alias("t"))))
        return F.transform(by_x, lambda i: i["t"])

    lines = let(steps, lambda every: F.filter(F.transform(every, lambda s: line(s, every)), lambda r: F.size(r) >= 3))
    longest = F.array_max(F.transform(lines, lambda r, i: F.struct(F.size(r).alias("s"), (-i).alias("i"), r.alias("r"))))
    return longest["r"]


def layout_pairs(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pair of frames that have at least two."""
    found = _items(items, keys).select(*keys, _pairs(F.col("items")).alias("p"))
    return (
        found.select(*keys, F.posexplode_outer(F.when(F.size("p") >= 2, F.col("p"))).alias("n", "pair"))
        .filter(F.col("pair").isNotNull())
        .withColumn("n", F.col("n") + 1)
    )


def layout_rows(items: DataFrame, keys: list[str]) -> DataFrame:
    """The longest horizontal line of labels per frame."""
    found = _items(items, keys).select(*keys, _row(F.col("items")).alias("r"))
    return found.filter(F.col("r").isNotNull()).select(
        *keys, F.size("r").alias("length"), F.array_join("r", " → ").alias("line")
    )


def layout_hints(items: DataFrame, keys: list[str]) -> DataFrame:
    """Both hints of a frame joined into one text; frames without any are left out."""
    found = _items(items, keys).select(*keys, _pairs(F.col("items")).alias("p"), _row(F.col("items")).alias("r"))
    pairs = F.when(F.size("p") >= 2, F.concat(F.lit(P.LAYOUT_PAIRS_LEAD), F.array_join("p", "、")))
    row = F.when(F.col("r").isNotNull(), F.concat(F.lit(P.LAYOUT_ROWS_LEAD), F.array_join("r", " → ")))
    return found.select(*keys, F.concat_ws("；", pairs, row).alias("hints")).filter(F.col("hints") != "")
