"""Row numbers and running totals for keys of any size.

A plain ``sum() over (partition by key order by pos)`` puts a whole key into one
task. Here a key is cut into stretches of ``width`` positions: totals per stretch
are pre-aggregated map-side, their running sum gives each stretch an offset, and the
fine window runs per (key, stretch). A hot key therefore spreads over as many tasks
as it has stretches, and a stretch of unique positions never exceeds ``width`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH = 1 << 17


def running(df: DataFrame, keys: Sequence[str], pos: str, *, ties: Sequence[str] = (),
            value: Column | None = None, number: str | None = None,
            total: str | None = None, width: float = STRETCH) -> DataFrame:
    """Add ``number`` (1-based row number) and/or ``total`` (running sum of ``value``,
    this row included) over each key in (pos, ties) order."""
    cut = F.floor(F.col(pos) / width)
    rows = df.withColumn("_stretch", cut)
    if total:
        rows = rows.withColumn("_value", value)
    sizes = [F.count(F.lit(1)).alias("_n")]
    if total:
        sizes.append(F.sum("_value").alias("_v"))
    by = [*keys, "_stretch"]
    coarse = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*by).agg(*sizes)
    picks = [F.coalesce(F.sum("_n").over(coarse), F.lit(0)).alias("_n0")]
    if total:
        picks.append(F.coalesce(F.sum("_v").over(coarse), F.lit(0)).alias("_v0"))
    offsets = offsets.select(*by, *picks)

    fine = W.partitionBy(*by).orderBy(pos, *ties)
    joined = rows.join(offsets, by)
    out = [c for c in df.columns]
    cols = [F.col(c) for c in out]
    if number:
        cols.append((F.col("_n0") + F.row_number().over(fine)).alias(number))
    if total:
        upto = fine.rowsBetween(W.unboundedPreceding, W.currentRow)
        cols.append((F.col("_v0") + F.sum("_value").over(upto)).alias(total))
    return joined.select(*cols)
