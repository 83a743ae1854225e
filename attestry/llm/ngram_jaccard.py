"""N-gram Jaccard join, size-aware heavy-light.

A document is the set of its distinct ``n``-word shingles. Two documents link when
100 * intersection >= percent * union. Identical sets are folded to one representative
first. Then, after the size-aware heavy-light scheme:

* light sets (at most ``boundary`` shingles) enumerate, for every partner size they could
  link with, all their subsets of exactly the overlap that such a link needs. Equal
  subsets prove the link of sets of the two sizes of a key, so its members are tied to
  one member of the other size. Two sets of one size are tied only by a key of that
  size twice, or by a set of the other size that both link with.
* heavy sets scan inverted lists. Shingles are ordered rarest first by their document
  frequency (a census, exact up to truncated keys, in powers of two) and only a set's
  prefix is listed, in which any partner must share a shingle; places in the prefix bound
  the possible overlap.
* the boundary is chosen by cost: number of subsets against length of the scanned lists,
  for every size up to ``light_max``.

Lists never pair all their members. First every member meets one pivot of the list, the
document whose shingles are the most frequent (the centre of a group of copies). Members
that link with the same pivot are connected already; only pairs of a list that are not,
and whose places allow enough overlap, are verified in a second pass. Verification joins
the whole sets and counts the exact intersection. The result is components, for which no
link between different texts is lost.

Defined results: a text with fewer than ``n`` words is one shingle, the whole sequence; a
null or blank text has an empty set and links with nothing; repeated rows link with each
other; rows that share a doc_id are one node; a null doc_id has a null component. Extra
columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import QUESTION, Asked, answered, gram_hashes, mixed, packets, partitions, plain_words, word_hashes
from .components import components

LIGHT_MAX = 12
CARD = ("doc_id long, n long, digest binary, centre double, cost double, tokens array<long>, places array<int>, "
        "shingles binary")


def needed(m: int, n: int, percent: int) -> int:
    """Least intersection with which sets of m and n elements link."""
    return -(-percent * (m + n) // (100 + percent))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    words = plain_words(text.translate(_LOWER) if text else None)
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < n:
        return mixed(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64))
    return np.unique(gram_hashes(hashes, n))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _sets(group: pa.Table, n: int) -> tuple[list, list[np.ndarray]]:
    texts = group["text"]
    return group["doc_id"].to_pylist(), [shingles(t.as_py(), n) for t in texts]


def cards(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One card per row: set size, digest of the set, and for sets that share a listed
    shingle with others its listed shingles, their places and the set itself."""
    buckets = partitions(docs.sparkSession)
    texts = packets(docs, "doc_id", "text")

    def ask(group: pa.Table) -> pa.Table:
        _, sets = _sets(group, n)
        return Asked(np.concatenate(sets), buckets).rows(group["packet"][0].as_py())

    def judge(total: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.ceil(np.log2(total)).astype(np.uint8)

    frequency = answered(texts.groupBy("packet").applyInArrow(ask, QUESTION), judge)

    def card(group: pa.Table, replies: pa.Table) -> pa.Table:
        ids, sets = _sets(group, n) if group.num_rows else ([], [])
        rarity = Asked(np.concatenate(sets), buckets).answers(replies) if sets else None
        out = {name: [] for name in ("n", "digest", "centre", "cost", "tokens", "places", "shingles")}
        done = 0
        for own in sets:
            size = len(own)
            level = rarity[done : done + size]
            done += size
            order = np.lexsort((own, level))[: size - ceil(percent * size / 100) + 1]
            live = np.flatnonzero(level[order] > 0) if size else np.empty(0, np.int64)
            shown = order[live] if size else live
            out["n"].append(size)
            out["digest"].append(xxhash.xxh128_digest(own.tobytes()))
            out["centre"].append(float(level.mean()) if size else 0.0)
            out["cost"].append(float(np.exp2(level[shown].astype(np.float64)).sum()))
            out["tokens"].append(own[shown].view(np.int64))
            out["places"].append(live.astype(np.int32))
            out["shingles"].append(own.astype("<u8").tobytes() if len(live) else None)
        lists = lambda parts, kind: pa.array(parts, pa.list_(kind))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n": pa.array(out["n"], pa.int64()),
            "digest": pa.array(out["digest"], pa.binary()), "centre": pa.array(out["centre"], pa.float64()),
            "cost": pa.array(out["cost"], pa.float64()), "tokens": lists(out["tokens"], pa.int64()),
            "places": lists(out["places"], pa.int32()), "shingles": pa.array(out["shingles"], pa.binary()),
        })

    return texts.groupBy("packet").cogroup(frequency.groupBy("packet")).applyInArrow(card, CARD)


def boundary_by_cost(sets: DataFrame, percent: int, light_max: int = LIGHT_MAX) -> int:
    """The largest size that enumerates subsets more cheaply than it scans lists; one row
    for each of at most ``light_max`` sizes reaches the driver."""
    sizes = sets.filter(F.col("n").between(1, light_max)).groupBy("n").agg(F.count("*").alias("rows"), F.sum("cost").alias("scan"))
    known = {r["n"]: (r["rows"], r["scan"]) for r in sizes.collect()}
    best, least, subsets, scans = 0, 0.0, 0.0, 0.0
    for size in range(1, light_max + 1):
        rows, scan = known.get(size, (0, 0.0))
        subsets += rows * sum(comb(size, need) for _, need in _partners(size, percent, light_max))
        scans += scan
        if subsets - scans < least:
            best, least = size, subsets - scans
    return best


def _partners(size: int, percent: int, most: int) -> list[tuple[int, int]]:
    """Sizes up to ``most`` that a set of ``size`` can link with, and the overlap needed."""
    return [(other, need) for other in range(1, most + 1)
            if (need := needed(size, other, percent)) <= min(size, other)]


def _light_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    def enumerate_subsets(batches):
        for batch in batches:
            keys, ids, own_sizes, alike = [], [], [], []
            for key, blob in zip(batch["digest"].to_pylist(), batch["shingles"].to_pylist(), strict=True):
                own = [blob[i : i + 8] for i in range(0, len(blob), 8)]
                for other, need in _partners(len(own), percent, boundary):
                    sizes = bytes(sorted((len(own), other)))
                    for subset in combinations(own, need):
                        keys.append(xxhash.xxh128_digest(sizes + b"".join(subset)))
                        ids.append(key)
                        own_sizes.append(len(own))
                        alike.append(len(own) == other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.binary()), pa.array(own_sizes, pa.int32()), pa.array(alike, pa.bool_())],
                ["key", "a", "size", "alike"])

    light = sets.filter(F.col("n") <= boundary).select("digest", "shingles")
    members = light.mapInArrow(enumerate_subsets, "key binary, a binary, size int, alike boolean")
    # The smallest member of the smaller size and one of the larger; a key of unlike sizes
    # proves nothing unless both are there.
    ends = members.groupBy("key").agg(
        F.min(F.struct("size", "a")).alias("low"), F.max(F.struct("size", "a")).alias("high"), F.count("*").alias("many")
    ).filter("many > 1").select("key", "low", "high")
    tied = members.join(ends, "key").filter("alike OR low.size < high.size")
    partner = F.when(F.col("size") < F.col("high.size"), F.col("high.a")).otherwise(F.col("low.a"))
    return tied.select("a", partner.alias("b")).filter("a <> b").distinct()


def _fits(left: str, right: str, percent: int):
    """The size and place bounds of a pair that shares the shingle of one list.

    At the first shingle that a pair shares nothing before it is shared, so the overlap is
    at most what is left of the shorter rest; a true pair meets this bound in the list of
    that shingle.
    """
    n1, n2 = F.col(f"{left}.n"), F.col(f"{right}.n")
    rest = F.least(n1 - F.col(f"{left}.place"), n2 - F.col(f"{right}.place"))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (rest * (100 + percent) >= (n1 + n2) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their exact intersection."""

    def count(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                left, right = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.searchsorted(left, right)
                at[at == len(left)] = 0
                both = int((left[at] == right).sum())
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(count, "a binary, b binary")


def _heavy_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    listed = sets.filter(F.col("n") * 100 >= F.lit((boundary + 1) * percent)).select(
        "digest", "n", "centre", F.explode(F.arrays_zip("tokens", "places")).alias("z"))
    postings = _kept(listed.select("digest", "n", "centre", F.col("z.tokens").alias("token"), F.col("z.places").alias("place")))
    heavy = F.greatest("p.n", "q.n") > boundary
    pivots = postings.groupBy("token").agg(
        F.max(F.struct("centre", "digest", "n", "place")).alias("top"), F.count("*").alias("many")
    ).filter("many > 1").select("token", "top.*")
    met = postings.alias("p").join(pivots.alias("q"), "token").filter(
        (F.col("p.digest") != F.col("q.digest")) & heavy & _fits("p", "q", percent)
    ).select(F.greatest("p.digest", "q.digest").alias("a"), F.least("p.digest", "q.digest").alias("b")).distinct()
    met = _kept(met)
    central = _kept(_verified(met, sets, percent))

    # One hop names what is connected already: the most central set that a set links with, itself included.
    centres = sets.select(F.col("digest").alias("b"), "centre")
    ways = central.unionByName(central.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = ways.join(centres, "b").groupBy(F.col("a").alias("digest")).agg(F.max(F.struct("centre", "b")).alias("top"))
    mine = F.struct(F.col("centre"), F.col("digest").alias("b"))
    labelled = postings.join(named, "digest", "left").withColumn("name", F.greatest("top", mine)["b"]).drop("top", "centre")
    lists = labelled.groupBy("token").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    open_ = _kept(labelled.join(lists.filter("lo <> hi").select("token"), "token"))
    across = open_.alias("p").join(open_.alias("q"), "token").filter(
        (F.col("p.name") != F.col("q.name")) & (F.col("p.digest") > F.col("q.digest")) & heavy & _fits("p", "q", percent)
    ).select(F.col("p.digest").alias("a"), F.col("q.digest").alias("b")).distinct()
    return central.unionByName(_verified(across.join(met, ["a", "b"], "left_anti"), sets, percent))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, light_max: int = LIGHT_MAX) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    every = _kept(cards(docs, n, percent))
    known = every.filter("n > 0 AND doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    same = known.select("doc_id", "digest").join(firsts, "digest").filter("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    listed = known.filter("shingles IS NOT NULL").select("doc_id", "digest", "n", "centre", "cost", "tokens", "places", "shingles")
    reps = listed.join(firsts.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).drop("doc_id")
    sets = _kept(reps.dropDuplicates(["digest"]))
    boundary = boundary_by_cost(sets, percent, light_max)
    links = _light_links(sets, boundary, percent).unionByName(_heavy_links(sets, boundary, percent))
    of = firsts.withColumnRenamed("rep", "b_rep")
    tied = links.join(firsts, links["a"] == firsts["digest"]).select("b", F.col("rep").alias("a_rep")).join(
        of, F.col("b") == of["digest"]).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    found = components(same.unionByName(tied))
    return every.select("doc_id", F.col("n").alias("n_shingles")).join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, without those of a component but the one with its
    smallest doc_id; of rows that repeat that doc_id one stays. Rows with a null doc_id stay."""
    found = jaccard_components(docs, n, percent)
    copies = found.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(copies, "doc_id", "left_anti")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    name = "_rank"
    while name in docs.columns:
        name += "_"
    return left.withColumn(name, rank).filter(F.col("doc_id").isNull() | (F.col(name) == 1)).select(*(f"`{c}`" for c in docs.columns))


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, as several steps read it."""
    return written(df, "jaccard")
