"""Ranked lexical search: an index of block postings, searched by Block-Max MaxScore.

**Index.** A run of rows of one input split, ``shard_bytes`` of text, is a shard; no text is
shuffled and no id or source is a key, so nothing can be hot. A shard has one row of its
documents (in doc_id order, with their lengths) and one row per term: postings in blocks of
``BLOCK``, packed as bytes, and for every block a head with its first and last document, its
highest frequency and its shortest document. The heads bound a block's scores for any corpus
statistics, so the index needs none; it is written to the shared folder.

**Search.** Document frequencies are summed for the terms that are asked for. Lists are
joined with the queries' terms (broadcast only behind a count of them, else shuffled) and
meet their shard's documents per (shard, block of queries). There, per query:

* lists are taken whole from the highest bound down until the bounds of the lists left sum to
  less than the k-th best score so far; these are the essential lists, and only documents in
  them can still be among the best;
* for those, the block maxima of the lists left are added up without unpacking anything;
  documents that stay below the k-th best are rejected, and only blocks that a remaining
  document falls in are unpacked, list by list.

The best of every shard are merged per query; Spark limits them before the exchange.

Defined results: a null text or one without terms is no document; a null doc_id is indexed and
stands last among ties; repeated documents are ranked each; an item without terms has no
rows, a repeated item (same item_id and text) counts once; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .benchmark_winnowing import words_of
from .common import folded_words

BLOCK = 128
SHARD_BYTES = 16 << 20
#: Queries that one task searches together.
QUERY_BLOCK = 1024
#: Distinct (query, term) pairs that may be broadcast: some tens of bytes each.
BROADCAST_TERMS = 500_000

HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("peak", "<u4"), ("least", "<u4"), ("offset", "<u4"), ("size", "<u2")])
INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("heads", pa.binary()), ("data", pa.binary())])
INDEX_ROW = "shard long, term string, n long, total long, heads binary, data binary"
WIDTHS = (1, 2, 4)


def width_code(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for every run from ``first``: its values fit in 1, 2 or 4 bytes."""
    peak = np.maximum.reduceat(values, first)
    return (peak > 0xFF).astype(np.int64) + (peak > 0xFFFF)


def packed_postings(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Blocks of postings sorted by (term, doc): heads, the term of each block, all bytes and
    the place of each block in them. A block is a width byte, document steps, frequencies."""
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    within = np.arange(len(term)) - np.repeat(start, np.diff(np.append(start, len(term))))
    first = np.flatnonzero(within % BLOCK == 0)
    size = np.diff(np.append(first, len(term)))
    block = np.repeat(np.arange(len(first)), size)
    step = np.concatenate([[0], doc[1:] - doc[:-1]])
    step[first] = 0
    code = [width_code(step, first), width_code(tf, first)]
    widths = [np.array(WIDTHS)[c] for c in code]
    space = 1 + size * (widths[0] + widths[1])
    at = np.concatenate([[0], np.cumsum(space)])
    data = np.zeros(at[-1], np.uint8)
    data[at[:-1]] = code[0] * 4 + code[1]
    place = np.arange(len(term)) - first[block]
    for values, width, begin in ((step, widths[0], at[:-1] + 1), (tf, widths[1], at[:-1] + 1 + size * widths[0])):
        spot = begin[block] + place * width[block]
        for byte in range(4):
            some = width[block] > byte
            data[spot[some] + byte] = values[some] >> (8 * byte) & 0xFF
    heads = np.zeros(len(first), HEAD)
    heads["first"], heads["last"], heads["size"] = doc[first], doc[first + size - 1], size
    heads["peak"], heads["least"] = np.maximum.reduceat(tf, first), np.minimum.reduceat(lengths[doc], first)
    return heads, term[first], data.tobytes(), at


def unpacked(data: bytes, head: np.void) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of one block."""
    at, size = int(head["offset"]), int(head["size"])
    steps, tfs = WIDTHS[data[at] >> 2], WIDTHS[data[at] & 3]
    step = np.frombuffer(data, f"<u{steps}", size, at + 1)
    return int(head["first"]) + np.cumsum(step, dtype=np.int64), np.frombuffer(data, f"<u{tfs}", size, at + 1 + size * steps).astype(np.int64)


def shard_rows(shard: int, ids: list[int | None], texts: list[str | None]) -> pa.Table:
    """The index rows of one shard."""
    vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    kept, terms, sizes = [], [], []
    for k in order:
        words = folded_words(texts[k])
        if words:
            kept.append(ids[k])
            terms.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
    if not kept:
        return INDEX.empty_table()
    lengths = np.array(sizes, np.int64)
    keys = np.concatenate(terms)
    del terms
    keys = (keys << np.uint64(32)) | np.repeat(np.arange(len(kept), dtype=np.uint64), lengths)
    keys, tf = np.unique(keys, return_counts=True)
    term, doc = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    heads, owner, data, at = packed_postings(term, doc, tf, lengths)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    edges = np.append(first, len(owner))
    begin = at[edges]
    heads["offset"] = at[:-1] - np.repeat(begin[:-1], np.diff(edges))
    names = list(vocabulary)  # in the order of their numbers
    blob = heads.tobytes()
    many = len(names)
    known = [i for i in kept if i is not None]
    return pa.table({
        "shard": pa.array(np.full(many + 1, shard, np.int64)),
        "term": pa.array([*(n.decode() for n in names), None], pa.string()),
        "n": pa.array(np.append(np.bincount(term, minlength=many), len(kept))),
        "total": pa.array(np.append(np.zeros(many, np.int64), lengths.sum())),
        "heads": pa.array([*(blob[s * HEAD.itemsize : e * HEAD.itemsize] for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())), lengths.astype("<u4").tobytes()], pa.binary()),
        "data": pa.array([*(data[s:e] for s, e in zip(begin[:-1].tolist(), begin[1:].tolist())), np.array(known, "<i8").tobytes()], pa.binary()),
    }, schema=INDEX)


def build_index(docs: DataFrame, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text), lazily: one row per shard and term, and one per
    shard without a term, which has the shard's documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        ids: list[int | None] = []
        texts: list[str | None] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                held += len(text or "")
                if held >= shard_bytes:
                    yield from shard_rows(shard, ids, texts).to_batches(1 << 15)
                    ids, texts, held, shard = [], [], 0, shard + 1
        yield from shard_rows(shard, ids, texts).to_batches(1 << 15)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(index, INDEX_ROW)


class PostingList:
    """One term's list in a shard: bounds of its blocks, and what has been unpacked of it."""

    def __init__(self, weight: int, heads: bytes, data: bytes, corpus: tuple[int, int]):
        self.heads, self.data, self.weight, self.corpus = np.frombuffer(heads, HEAD), data, weight, corpus
        self.first, self.last = self.heads["first"].astype(np.int64), self.heads["last"].astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(self.heads["size"], dtype=np.int64)])
        self.bounds = weight * impact(self.heads["peak"].astype(np.int64), self.heads["least"].astype(np.int64), *corpus)
        self.bound = int(self.bounds.max())
        self.docs = np.empty(self.edges[-1], np.int64)
        self.scores = np.empty(self.edges[-1], np.int64)
        self.ready = np.zeros(len(self.heads), bool)

    def unpack(self, blocks: np.ndarray, lengths: np.ndarray) -> None:
        for b in blocks[~self.ready[blocks]].tolist():
            s, e = self.edges[b], self.edges[b + 1]
            self.docs[s:e], tf = unpacked(self.data, self.heads[b])
            self.scores[s:e] = self.weight * impact(tf, lengths[self.docs[s:e]], *self.corpus)
            self.ready[b] = True

    def whole(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.unpack(np.arange(len(self.heads)), lengths)
        return self.docs, self.scores

    def blocks_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each document falls in, and that block's bound (0 between blocks)."""
        at = np.minimum(np.searchsorted(self.last, docs), len(self.last) - 1)
        return at, np.where((self.first[at] <= docs) & (docs <= self.last[at]), self.bounds[at], 0)

    def scores_of(self, docs: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of documents in the given blocks; 0 where a document lacks the term."""
        blocks = np.unique(at)
        self.unpack(blocks, lengths)
        here = np.concatenate([np.arange(self.edges[b], self.edges[b + 1]) for b in blocks.tolist()])
        spot = np.minimum(np.searchsorted(self.docs[here], docs), len(here) - 1)
        return np.where(self.docs[here[spot]] == docs, self.scores[here[spot]], 0)


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence list adds per unit of weight: grows with tf, falls with length."""
    m = 100 - 25 + (25 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th best score; 1, the least that counts, where there are fewer."""
    return max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else 1


def best_of_shard(lists: list[tuple[PostingList, int]], lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of a query's k best in a shard, by MaxScore over block maxima.
    ``lists`` are the query's terms that the shard has, with their repeats in the query."""
    lists = sorted(lists, key=lambda x: -x[0].bound * x[1])
    rest = np.append(np.cumsum([p.bound * r for p, r in lists][::-1])[::-1], 0)
    sums, least, taken = np.zeros(len(lengths), np.int64), 1, 0
    while taken < len(lists) and rest[taken] >= least:
        posting, repeats = lists[taken]
        docs, scores = posting.whole(lengths)
        sums[docs] += scores * repeats
        taken += 1
        least = max(least, kth(sums[sums > 0], k))
    docs = np.flatnonzero(sums + rest[taken] >= least) if taken else np.empty(0, np.int64)
    docs = docs[sums[docs] > 0]
    scores, left = sums[docs], lists[taken:]
    places = [p.blocks_of(docs) for p, _ in left]
    ahead = np.array([bound * r for (_, bound), (_, r) in zip(places, left, strict=True)]).reshape(len(left), len(docs))
    ahead = np.concatenate([np.cumsum(ahead[::-1], axis=0)[::-1], np.zeros((1, len(docs)), np.int64)])
    alive = np.arange(len(docs))
    for i, (posting, repeats) in enumerate(left):
        alive = alive[scores[alive] + ahead[i, alive] >= least]
        at, bound = places[i]
        here = alive[bound[alive] > 0]
        if len(here):
            scores[here] += posting.scores_of(docs[here], at[here], lengths) * repeats
            least = max(least, kth(scores[alive], k))
    alive = alive[scores[alive] >= least]
    top = alive[np.lexsort((docs[alive], -scores[alive]))][:k]
    return docs[top], scores[top]


def search(index: DataFrame, items: DataFrame, *, k: int = 20, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best documents of a written ``index`` for every item (item_id, text):
    (item_id, rank, doc_id, score)."""
    queries = written(
        items.select("item_id", "text").distinct().withColumn("_q", F.monotonically_increasing_id()), "search-queries")
    # Numbers without gaps, so that blocks of queries are full.
    starts = queries.groupBy(F.shiftright("_q", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_from"))
    numbered = queries.withColumn("_p", F.shiftright("_q", 33)).join(starts, "_p").select(
        "item_id", "text", "_q", F.expr(f"(_from + (_q & 8589934591)) div {query_block}").alias("_block"))
    asked = written(
        numbered.select("_q", "_block", F.explode(words_of(F.col("text"))).alias("term"))
        .groupBy("_block", "term", "_q").agg(F.count(F.lit(1)).alias("r")), "search-terms")
    sizes = index.filter("term IS NULL").agg(F.sum("n"), F.sum("total")).first()
    corpus = (sizes[0] or 0, max(sizes[1] or 0, 1))
    few = asked.count() <= BROADCAST_TERMS
    hinted = F.broadcast if few else lambda df: df

    postings = index.filter("term IS NOT NULL")
    found = postings.select("term", "n").join(hinted(asked.select("term").distinct()), "term")
    weight = F.floor(F.lit(1000) * F.log((2 * F.lit(corpus[0]) + 2).cast("double") / (2 * F.sum("n") + 1).cast("double")))
    weights = found.groupBy("term").agg(weight.cast("long").alias("w")).filter("w > 0")
    uses = asked.groupBy("_block", "term").agg(F.collect_list(F.struct("_q", "r")).alias("uses"))
    wanted = written(uses.join(weights, "term"), "search-wanted")
    blocks = wanted.agg(F.max("_block")).first()[0] or 0
    lists = postings.select("shard", "term", "heads", "data").join(hinted(wanted), "term")
    shards = index.filter("term IS NULL").select(
        F.col("shard").alias("at"), F.col("heads").alias("lengths"), F.col("data").alias("ids"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks).cast("long"))).alias("part"))

    def best(some: pa.Table, shard: pa.Table) -> pa.Table:
        out: dict[str, list] = {"_q": [], "doc_id": [], "score": []}
        if some.num_rows:
            lengths = np.frombuffer(shard["lengths"][0].as_py(), "<u4").astype(np.int64)
            ids = np.frombuffer(shard["ids"][0].as_py(), "<i8").tolist()
            ids += [None] * (len(lengths) - len(ids))
            by_query: defaultdict[int, list[tuple[PostingList, int]]] = defaultdict(list)
            for w, heads, data, used in zip(*(some[c].to_pylist() for c in ("w", "heads", "data", "uses")), strict=True):
                posting = PostingList(w, heads, data, corpus)
                for use in used:
                    by_query[use["_q"]].append((posting, use["r"]))
            for q, mine in by_query.items():
                docs, scores = best_of_shard(mine, lengths, k)
                out["_q"] += [q] * len(docs)
                out["doc_id"] += [ids[d] for d in docs.tolist()]
                out["score"] += scores.tolist()
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    heaps = lists.groupBy("shard", "_block").cogroup(shards.groupBy("at", "part")).applyInArrow(best, "_q long, doc_id long, score long")
    order = W.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("_q", "item_id"), "_q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 20, shard_bytes: int = SHARD_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Index ``docs``, write the index, search it for ``items``."""
    return search(written(build_index(docs, shard_bytes=shard_bytes), "search-index"), items, k=k, query_block=query_block)
