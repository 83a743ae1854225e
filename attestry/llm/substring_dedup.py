"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words, which are
indexed; all documents probe the index with every rolling window of ``block`` words. With
``2 * block <= window + 1`` any ``window`` consecutive words contain a whole reference
block of their own document, so every passage of ``window`` words that occurs twice is
anchored: its copy's rolling window meets the block. Anchors are extended on both sides to
the windows around them; the union of repeated windows is the maximal exact repeat.

The index is the census of ``common.py`` (four bytes for each distinct rolling window of a
packet, flagged where it is a reference block); the windows around anchors are grouped by
their hash, aggregated to their first place per packet before the exchange. No pair of
occurrences is ever formed, so a passage shared by a third of all documents costs one
entry per packet.

Defined results: a null or blank text has no words and keeps the digest of nothing; rows
that share a doc_id are one place in the order (equal starts are not earlier than each
other); a null doc_id comes after all others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import QUESTION, Asked, answered, gram_hashes, packets, partitions, plain_words, word_hashes

LAST = np.int64(2**63 - 1)
WINDOWS = "packet int, bucket int, keys binary, docs binary, starts binary"
LATER = "packet int, bucket int, later binary"
ALIGNED, LIVE = 1, 1


class _Packet:
    """Word hashes and rolling anchors of one packet's rows, in (doc_id, row) order."""

    def __init__(self, table: pa.Table, block: int):
        ids = table["doc_id"].to_pylist()
        texts = table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.words = [plain_words(texts[i]) for i in order]
        self.hashes = [word_hashes(w) for w in self.words]
        anchors = [gram_hashes(h, block) for h in self.hashes]
        self.sizes = np.array([len(a) for a in anchors], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.keys = np.concatenate(anchors) if anchors else np.empty(0, np.uint64)
        self.places = np.concatenate([np.arange(n) for n in self.sizes]) if len(self.sizes) else np.empty(0, np.int64)


def _windows(packet: _Packet, live: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and start of every window that contains a live anchor."""
    hashes, rows, starts = [], [], []
    reach = window - block + 1
    for row, (first, last) in enumerate(zip(packet.ends[:-1], packet.ends[1:], strict=True)):
        count = len(packet.hashes[row]) - window + 1
        if count <= 0 or not live[first:last].any():
            continue
        seen = np.concatenate([[0], np.cumsum(live[first:last])])
        at = np.flatnonzero(seen[reach : reach + count] > seen[:count])
        hashes.append(gram_hashes(packet.hashes[row], window)[at])
        rows.append(np.full(len(at), row, np.int64))
        starts.append(at)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(starts)


class _Entries:
    """The distinct windows of one packet, each by its first (doc_id, start), ordered by
    bucket and place; both passes over a packet derive the same order."""

    def __init__(self, own: _Packet, hashes: np.ndarray, rows: np.ndarray, starts: np.ndarray, buckets: int):
        ids = np.array([LAST if i is None else i for i in own.ids], np.int64)
        self.hashes, self.rows, self.starts, self.place = hashes, rows, starts, ids[rows]
        order = np.lexsort((starts, self.place, hashes))
        fresh = np.ones(len(order), bool)
        fresh[1:] = hashes[order][1:] != hashes[order][:-1]
        lead = order[fresh]
        bucket = (hashes[lead] >> np.uint64(32)) % np.uint64(buckets)
        rank = np.lexsort((hashes[lead], starts[lead], self.place[lead], bucket))
        self.lead = lead[rank]
        self.edges = np.searchsorted(bucket[rank], np.arange(buckets + 1, dtype=np.uint64))
        self.entry = np.empty(len(order), np.int64)
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        self.entry[order] = back[np.cumsum(fresh) - 1]

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.hashes[self.lead].astype("<u8"), self.place[self.lead].astype("<i8"), self.starts[self.lead].astype("<u4")

    def later(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows and starts of the windows that have an earlier place, here or elsewhere."""
        elsewhere = np.zeros(len(self.lead), np.uint8)
        for bucket, reply in zip(replies["bucket"].to_pylist(), replies["later"].to_pylist(), strict=True):
            elsewhere[self.edges[bucket] : self.edges[bucket + 1]] = np.frombuffer(reply, np.uint8)
        lead = self.lead[self.entry]
        here = (self.place[lead] != self.place) | (self.starts[lead] != self.starts)
        pick = here | (elsewhere[self.entry] > 0)
        return self.rows[pick], self.starts[pick]


def _questions(packet: int, buckets: list, keys: list, docs: list, starts: list) -> pa.Table:
    return pa.table({
        "packet": pa.array([packet] * len(buckets), pa.int32()), "bucket": pa.array(buckets, pa.int32()),
        "keys": pa.array(keys, pa.binary()), "docs": pa.array(docs, pa.binary()), "starts": pa.array(starts, pa.binary()),
    })


def repeated_words(docs: DataFrame, window: int = 20, block: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256
    and ``removed`` (start and end word of each maximal removed stretch)."""
    if 2 * block > window + 1:
        raise ValueError("a window must contain a whole reference block: 2 * block <= window + 1")
    buckets = partitions(docs.sparkSession)
    texts = packets(docs, "doc_id", "text")

    def ask(group: pa.Table) -> pa.Table:
        own = _Packet(group, block)
        asked = Asked(own.keys, buckets)
        flags = np.zeros(len(asked.distinct), np.uint8)
        flags[asked.at[own.places % block == 0]] = ALIGNED
        return asked.rows(group["packet"][0].as_py(), flags)

    def judge(total: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.where((total > 1) & (flags & ALIGNED > 0), LIVE, 0)

    # Read by two steps; written, so that the census answers once.
    anchored = written(answered(texts.groupBy("packet").applyInArrow(ask, QUESTION), judge), "anchors")

    def candidates(group: pa.Table, replies: pa.Table) -> tuple[_Packet, _Entries]:
        own = _Packet(group, block)
        live = Asked(own.keys, buckets).answers(replies) == LIVE
        return own, _Entries(own, *_windows(own, live, block, window), buckets)

    def extend(group: pa.Table, replies: pa.Table) -> pa.Table:
        """Ask about the windows around live anchors, with their first place in the packet."""
        if not group.num_rows:
            return _questions(0, [], [], [], [])
        _, entries = candidates(group, replies)
        keys, docs_, starts = entries.first()
        spans = [(b, int(s), int(e)) for b, (s, e) in enumerate(zip(entries.edges[:-1], entries.edges[1:], strict=True)) if e > s]
        return _questions(
            group["packet"][0].as_py(), [b for b, _, _ in spans], [keys[s:e].tobytes() for _, s, e in spans],
            [np.diff(docs_[s:e], prepend=np.int64(0)).tobytes() for _, s, e in spans], [starts[s:e].tobytes() for _, s, e in spans])

    def earlier_elsewhere(group: pa.Table) -> pa.Table:
        """Answer, for every asked window, whether another packet has an earlier place."""
        blobs = [np.frombuffer(x, "<u8") for x in group["keys"].to_pylist()]
        keys = np.concatenate(blobs)
        ids = np.concatenate([np.cumsum(np.frombuffer(x, "<i8")) for x in group["docs"].to_pylist()])
        starts = np.frombuffer(b"".join(group["starts"].to_pylist()), "<u4")
        order = np.lexsort((starts, ids, keys))
        fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        lead = np.empty(len(keys), np.int64)
        lead[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        later = ((ids[lead] != ids) | (starts[lead] != starts)).astype(np.uint8).tobytes()
        ends = np.cumsum([0, *map(len, blobs)]).tolist()
        return pa.table({
            "packet": group["packet"].combine_chunks(), "bucket": group["bucket"].combine_chunks(),
            "later": pa.array([later[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    asked = texts.groupBy("packet").cogroup(anchored.groupBy("packet")).applyInArrow(extend, WINDOWS)
    firsts = asked.groupBy("bucket").applyInArrow(earlier_elsewhere, LATER)
    both = anchored.withColumn("later", F.lit(None).cast("binary")).unionByName(
        firsts.withColumn("reply", F.lit(None).cast("binary"))
    )

    def remove(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _result([], [], [], [], [])
        own, entries = candidates(group, told.filter(told["reply"].is_valid()))
        rows, starts = entries.later(told.filter(told["later"].is_valid()))
        split = np.searchsorted(rows, np.arange(len(own.ids) + 1))
        n_words, n_removed, digests, removed = [], [], [], []
        for row, words in enumerate(own.words):
            at = starts[split[row] : split[row + 1]]
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            kept = words if not len(at) else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            removed.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
        return _result(own.ids, n_words, n_removed, digests, removed)

    return texts.groupBy("packet").cogroup(both.groupBy("packet")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>")


def _result(ids, n_words, n_removed, digests, removed) -> pa.Table:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        "removed": pa.array(removed, spans),
    })
