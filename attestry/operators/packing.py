"""Greedy packing of rows, for keys of any size.

A pack closes before an item that would take its size past a limit, or that starts a span
after the pack's own start. Where a pack opens so depends on all packs before it, which a
running sum cannot tell and a fold can only tell one item after another. Here the chain is
cut into *stretches* of ``width`` items:

* every item's next cut (where the pack would end, if one opened at it) comes from running
  totals by bisection, and from maxima over runs of doubling length where time decides;
* a pack is at most ``reach`` items long, as items have a size of one at least. A stretch is
  thus entered at one of its first ``reach`` items, and pointer doubling inside it gives for
  each of them the first cut behind the stretch: its *map*;
* maps of a key compose by pointer doubling as tables, so that log2(stretches) joins mark the
  entries that are really reached, with the number of packs before them;
* from its entry, every stretch marks its own cuts.

Only keys of more than one stretch have maps. Rows of many keys pass through a task in one
stream sorted by key, so short keys cost no group each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

WIDTH = 1 << 16


def next_cuts(first: np.ndarray, size: np.ndarray, at: np.ndarray | None, max_size: int, max_span: float | None, joiner: int) -> np.ndarray:
    """Where a pack that opens at each item would close: the place of the first item it cannot
    take, or the end of the item's own run. ``first`` flags the first item of each run."""
    n = len(size)
    here = np.arange(n)
    ends = np.append(np.flatnonzero(first)[1:], n)
    end = ends[np.cumsum(first) - 1]
    total = np.cumsum(size + joiner)
    cut = np.searchsorted(total, total - (size + joiner) + max_size + 2 * joiner, side="right")
    cut = np.minimum(np.maximum(cut, here + 1), end)
    if max_span is None or not n:
        return cut
    # The first later item at or past the limit, found by skipping runs whose maximum is below it.
    limit = np.where(np.isnan(at), np.inf, at + max_span)
    level = [np.where(np.isnan(at), -np.inf, at)]
    longest = int((cut - here).max())
    while (1 << len(level)) <= longest:
        half, last = 1 << (len(level) - 1), level[-1]
        level.append(np.maximum(last, np.append(last[half:], np.full(min(half, n), -np.inf))[:n]))
    place = here + 1
    for k in range(len(level) - 1, -1, -1):
        inside = np.flatnonzero(place + (1 << k) <= cut)
        inside = inside[level[k][place[inside]] < limit[inside]]
        place[inside] += 1 << k
    return np.minimum(place, cut)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole stretches from rows that are sorted by (key, stretch, number): the first row of a
    stretch has the number that the stretch begins with."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        opens = np.flatnonzero(batch["_first"].to_numpy(zero_copy_only=False))
        if len(opens) and opens[-1] + sum(b.num_rows for b in held) > 0:
            last = int(opens[-1])
            whole = pa.Table.from_batches([*held, batch.slice(0, last)])
            if whole.num_rows:
                yield whole
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, timed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    first, number, size = (table[c].to_numpy() for c in ("_first", "_n", "_size"))
    at = table["_at"].cast(pa.float64()).fill_null(float("nan")).to_numpy() if timed else None
    if len(size) and size.min() < 1:
        raise ValueError("an item to be packed must have a size of one at least")
    return first, number, size, at


def packed(rows: DataFrame, keys: list[str], number: str, size: Column, *, max_size: int, at: Column | None = None,
           max_span: float | None = None, joiner: int = 0, name: str = "pack", width: int = WIDTH) -> DataFrame:
    """Add ``name``, the number from 1 of each row's pack within its key, in the order of
    ``number``, which counts a key's rows from 1 (``prefix.running``). ``size`` is a positive number for every row; ``joiner`` is added
    between items; without ``max_span`` only the size closes a pack. A null ``at`` never
    closes a pack, nor does a pack that opens at one close by time. ``rows`` are read more than
    once: pass a written table where they are costly to make."""
    reach = math.ceil((max_size + 2 * joiner) / (1 + joiner)) + 2
    if width <= reach:
        raise ValueError("a stretch must be longer than the longest pack")
    timed = at is not None and max_span is not None
    numbers = [size.cast("long").alias("_size"), (at if timed else F.lit(None)).cast("double").alias("_at")]
    numbered = rows.select("*", *numbers, F.col(number).cast("long").alias("_n")).withColumn("_stretch", F.expr(f"(_n - 1) div {width}"))
    columns = [F.col(c) for c in rows.columns]
    last = numbered.agg(F.max("_stretch")).first()[0] or 0
    key = F.struct(*keys).alias("_key")
    start = F.col("_stretch") * width + 1

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            first, number, size, at = _numbers(table, timed)
            cut = next_cuts(first, size, at, max_size, max_span, joiner)
            stretch = table["_stretch"].to_numpy()
            begin = np.flatnonzero(first)
            for s, e in zip(begin.tolist(), np.append(begin[1:], len(first)).tolist()):
                if e - s <= width:  # the last stretch of its key
                    continue
                pointer = np.minimum(cut[s:e] - s, e - s)
                jump, packs = np.append(pointer, e - s), np.append(np.ones(e - s, np.int64), 0)
                inside = np.flatnonzero(jump[:width] < width)
                while len(inside):  # double until every pointer is behind the stretch
                    packs[inside] += packs[jump[inside]]
                    jump[inside] = jump[jump[inside]]
                    inside = inside[jump[inside] < width]
                # A chain that ends with the key goes on at the place behind its last item.
                entries = np.arange(1 if stretch[s] == 0 else reach)
                yield pa.RecordBatch.from_arrays(
                    [table["_key"].slice(s, 1).combine_chunks().take(pa.array(np.zeros(len(entries), np.int64))),
                     pa.array(number[s] + entries), pa.array(number[s] + jump[entries]), pa.array(packs[entries])],
                    ["_key", "_from", "_to", "_packs"])

    def reached() -> DataFrame:
        """(_key, _from, _before): where each stretch is entered."""
        near = F.when((F.col("_n") - start < reach) & (F.col("_stretch") > 0), F.array(F.col("_stretch"), F.col("_stretch") - 1))
        spread = numbered.select(key, "_n", "_size", "_at", F.explode(F.coalesce(near, F.array("_stretch"))).alias("_stretch"))
        spread = spread.withColumn("_first", F.col("_n") == start).repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_n")
        kind = spread.schema["_key"].dataType.simpleString()
        step = written(spread.mapInArrow(exits, f"_key {kind}, _from long, _to long, _packs long"), "packing-maps")
        met = step.filter("_from = 1").select("_key", "_from", F.lit(0).cast("long").alias("_before"))
        for _ in range(int(last).bit_length()):
            onward = met.join(step, ["_key", "_from"]).select("_key", F.col("_to").alias("_from"), (F.col("_before") + F.col("_packs")).alias("_before"))
            met = written(met.unionByName(onward).distinct(), "packing-entries")
            far = step.select("_key", F.col("_from").alias("_to"), F.col("_to").alias("_end"), F.col("_packs").alias("_more"))
            step = written(step.join(far, ["_key", "_to"]).select(
                "_key", "_from", F.col("_end").alias("_to"), (F.col("_packs") + F.col("_more")).alias("_packs")), "packing-maps")
        return met

    if last:
        entries = reached().select("_key", F.floor((F.col("_from") - 1) / width).cast("long").alias("_stretch"), F.col("_from").alias("_entry"), "_before")
        placed = numbered.withColumn("_key", F.struct(*keys)).join(entries, ["_key", "_stretch"], "left").drop("_key")
        placed = placed.withColumns({  # keys of one stretch have no maps
            "_entry": F.when(F.col("_stretch") == 0, 1).otherwise(F.col("_entry")),
            "_before": F.when(F.col("_stretch") == 0, 0).otherwise(F.col("_before"))})
    else:
        placed = numbered.withColumn("_entry", F.lit(1).cast("long")).withColumn("_before", F.lit(0).cast("long"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            first, number, size, at = _numbers(table, timed)
            cut = next_cuts(first, size, at, max_size, max_span, joiner)
            begin = np.flatnonzero(first)
            pointers, opens = cut.tolist(), np.zeros(len(first), np.int64)
            enter = begin + table["_entry"].to_numpy()[begin] - number[begin]
            for place, e in zip(enter.tolist(), np.append(begin[1:], len(first)).tolist()):
                while place < e:
                    opens[place] = 1
                    place = pointers[place]
            upto = np.cumsum(opens)
            run = np.cumsum(first) - 1
            pack = table["_before"].to_numpy() + upto - (upto - opens)[begin][run]
            yield from table.drop_columns(["_first", "_n", "_size", "_at", "_stretch", "_entry", "_before"]).append_column("_pack", pa.array(pack)).to_batches()

    ordered = placed.withColumn("_first", F.col("_n") == start).repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_n")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    inside = ordered.select(*columns, "_first", "_n", "_size", "_at", "_stretch", "_entry", "_before")
    return inside.mapInArrow(marked, f"{kinds}, _pack long").withColumnRenamed("_pack", name)
