"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a map-side combined minimum per node and one join; hubs are split by adaptive
skew joins. Every round is cut with ``checkpoint()`` in the shared folder, so a lost
executor costs one round. Links are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie every neighbour to the smallest node of its neighbourhood."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both if large else both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        pairs = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return pairs.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component its smallest node.

    Nulls and self links are ignored; an empty table gives an empty table.
    """
    shared_folder(links.sparkSession)
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(rounds):
        now = _star(_star(now, True), False).checkpoint()
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    leaves = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return leaves.unionByName(roots)
