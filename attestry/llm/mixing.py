"""Mixing sources to target weights by proportionate-fair scheduling.

Documents of a source form blocks of ``block`` rows in a fixed pseudo-random order. With
integer target weights a source's k-th block of a period is released at slot
floor(k * L / weight) and due by slot ceil((k + 1) * L / weight), L being the sum of the
weights; earliest deadline first then interleaves the sources so that no source is ever a
whole block ahead of or behind its target share. The schedule repeats every L slots, so it
is computed once for a period, inside one expression over the weights, and documents find
their slot by a join on (phase, source, place in the period). When a source has no blocks
left a new phase begins, in which the others share the slots by their own weights; nothing
is dropped or repeated.

All of it is DataFrame operations: numbering within a source works per hash cell with
pre-aggregated offsets, so a source with a third of all rows is thousands of small
windows, and schedules grow with the number of sources only.

Defined results: a null source is a source of its own; sources without a weight have
``default_weight``; ties of the order (rows with the same doc_id) fall by source, then
content. An empty table gives an empty table. Extra columns are kept by ``mixed`` as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weight_of(source: Column, weights: dict[str, int], default_weight: int) -> Column:
    chosen = reduce(lambda c, item: c.when(source == item[0], F.lit(item[1])), weights.items(), F.when(F.lit(False), F.lit(0)))
    return chosen.otherwise(F.lit(default_weight)).cast("long")


def schedule(shares: Column) -> Column:
    """The sources (positions in ``shares``, an array of weights) of one period's slots, by
    earliest deadline first among released blocks; ties fall to the earlier position.

    The fold walks the period's slots; its state is the blocks given to each source so far.
    The period is the sum of the weights, a few hundred slots, whatever the data.
    """
    total = F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(F.transform(shares, lambda _: F.lit(0).cast("long")).alias("given"), F.array().cast("array<int>").alias("slots"))

    def step(state: Column, slot: Column) -> Column:
        # Deadline times L is compared, in whole numbers; a source that is not released or has had all its blocks waits.
        due = F.transform(shares, lambda share, k: F.when(
            (state["given"][k] < share) & (F.floor(state["given"][k] * total / share) <= slot),
            F.struct(F.ceil((state["given"][k] + 1) * total / share).alias("due"), k.alias("k"))))
        pick = F.array_min(F.filter(due, lambda d: d.isNotNull()))["k"]
        return F.struct(
            F.transform(state["given"], lambda g, k: g + F.when(k == pick, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("given"),
            F.array_append(state["slots"], pick).alias("slots"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step, lambda state: state["slots"])


def _phases(counts: DataFrame) -> DataFrame:
    """(phase, from_period, base_slot, length, source, share) for every phase of the mix; counts has source, weight, blocks.

    Phases are cut where a source's last period begins and where it ends, so within one the
    shares are constant.
    """
    ends = counts.select("source", "weight", "blocks", F.ceil(F.col("blocks") / F.col("weight")).alias("periods"))
    every = ends.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.lit(0).cast("long"), F.col("periods") - 1, F.col("periods")))))).alias("cuts"),
        F.array_sort(F.collect_list(F.struct("source", "weight", "blocks"))).alias("sources"))
    spans = every.select("sources", F.posexplode(F.arrays_zip(
        F.slice("cuts", F.lit(1), F.size("cuts") - 1).alias("lo"), F.slice("cuts", F.lit(2), F.size("cuts") - 1).alias("hi"))).alias("phase", "span"))
    shared = spans.select(
        "phase", F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"), "sources",
        F.transform("sources", lambda s: F.greatest(F.lit(0).cast("long"), F.least(s["weight"], s["blocks"] - F.col("span.lo") * s["weight"]))).alias("shares"))
    timed = shared.withColumn("length", F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x))
    before = F.coalesce(F.sum(F.col("length") * (F.col("hi") - F.col("lo"))).over(W.orderBy("phase").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return timed.withColumn("base_slot", before)


def mix_slots(docs: DataFrame, weights: dict[str, int], *, default_weight: int = 1, block: int = 1, cells_hex: int = 3) -> DataFrame:
    """``docs`` (doc_id, source and other columns not named like the new ones) with ``_block`` (number within its
    source), ``_in_block`` and ``_slot`` (place of the block in the mix, dense from 0)."""
    keyed = docs.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn(
        "_cell", F.substring("_key", 1, cells_hex))
    cells = keyed.groupBy("source", "_cell").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("source", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    counts = cells.groupBy("source").agg(F.sum("n").alias("n")).select(
        "source", weight_of(F.col("source"), weights, default_weight).alias("weight"), F.ceil(F.col("n") / block).alias("blocks"))
    phases = _phases(counts)
    slots = phases.select("phase", "sources", F.posexplode(schedule(F.col("shares"))).alias("slot_in", "at"))
    placed = slots.select(
        "phase", F.col("sources")[F.col("at")]["source"].alias("source"), "slot_in").withColumn(
        "nth", F.row_number().over(W.partitionBy("phase", "source").orderBy("slot_in")) - 1)
    plan = placed.join(phases.select("phase", "lo", "length", "base_slot"), "phase")
    starts = phases.select(F.explode("sources").alias("s"), "lo").groupBy(F.col("s.source").alias("source")).agg(
        F.first("s.weight").alias("weight"), F.array_sort(F.collect_list("lo")).alias("lows"))

    same = lambda a, b: a.eqNullSafe(b)
    fine = W.partitionBy("source", "_cell").orderBy("_key", F.col("doc_id"), *[c for c in docs.columns if c in ("text",)])
    rows = keyed.join(offsets.withColumnRenamed("source", "_s").withColumnRenamed("_cell", "_c"), same(F.col("source"), F.col("_s")) & (F.col("_cell") == F.col("_c"))).drop("_s", "_c")
    numbered = rows.withColumn("_n", F.col("_before") + F.row_number().over(fine) - 1).withColumn("_block", F.floor(F.col("_n") / block))
    known = numbered.join(starts.withColumnRenamed("source", "_s"), same(F.col("source"), F.col("_s"))).drop("_s")
    timed = known.withColumn("_period", F.floor(F.col("_block") / F.col("weight"))).withColumn(
        "_phase", F.size(F.filter("lows", lambda lo: lo <= F.col("_period"))) - 1).withColumn(
        "_nth", F.col("_block") % F.col("weight"))
    found = timed.join(plan.select(F.col("phase").alias("_p"), F.col("source").alias("_s"), F.col("nth").alias("_k"), "lo", "length", "base_slot", "slot_in"),
                       (F.col("_phase") == F.col("_p")) & same(F.col("source"), F.col("_s")) & (F.col("_nth") == F.col("_k")))
    return found.select(
        *docs.columns, "_block", (F.col("_n") % block).alias("_in_block"),
        (F.col("base_slot") + (F.col("_period") - F.col("lo")) * F.col("length") + F.col("slot_in")).alias("_slot"))


def mixed(docs: DataFrame, weights: dict[str, int], *, default_weight: int = 1, block: int = 1) -> DataFrame:
    """The rows of ``docs`` in mix order: ranges of slots, in order within and across files."""
    whole = docs.select("doc_id", "source", F.xxhash64("text").alias("text"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("_doc"))
    placed = mix_slots(whole, weights, default_weight=default_weight, block=block)
    return placed.repartitionByRange("_slot", "_in_block").sortWithinPartitions("_slot", "_in_block").select("_doc.*")
