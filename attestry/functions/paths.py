"""Path rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import let


def stays_inside(path: Column) -> Column:
    """A relative path that never climbs above the folder it is resolved in."""
    depth = F.aggregate(
        F.split(path, r"[/\\]"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, part: let(
            acc["now"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1),
            lambda now: F.struct(now.alias("now"), F.least(acc["low"], now).alias("low")),
        ),
        lambda acc: acc["low"],
    )
    return ~path.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:|\A[/\\]") & (depth >= 0)
