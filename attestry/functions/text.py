"""Column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(col: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " "))


def is_blank(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


def lines_of(col: Column) -> Column:
    return F.split(col, P.LINE_BREAK)


def numbered(prefix: str, n: Column) -> Column:
    """``S001``-style id: at least three digits, more when needed."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.when(n < 1000, F.lpad(digits, 3, "0")).otherwise(digits))


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(s / 3600).cast("long"),
        F.floor(s / 60).cast("long") % 60,
        s % 60,
    )


def watch_link(video: Column, seconds: Column) -> Column:
    return F.concat(
        F.lit("https://www.youtube.com/watch?v="),
        video,
        F.lit("&t="),
        seconds.cast("long").cast("string"),
        F.lit("s"),
    )


def hits(col: Column, patterns) -> Column:
    """How many of the patterns occur in the text."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + col.rlike(pattern).cast("int")
    return total
