"""Shared helpers: word splitting, word and n-gram hashes, packets of documents, and a
distributed census that tells every packet how often its keys occur in the corpus.

A *packet* is a fixed hash class of document ids: its rows meet in one task, and there
are so many packets that each holds a few megabytes of text. The census is one exchange
of packed binary keys: packets ask about their distinct keys, one row per (packet,
bucket); buckets answer with one byte per key. A key held by a third of all documents
costs one entry per packet, never one per document, and no table is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes outside 0-9, a-z (after lower-casing A-Z) and the bytes of non-ASCII characters.
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else (c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32)
    for c in range(256)
)

MULTIPLIER = 0x9E3779B97F4A7C15
PACKETS_PER_PARTITION = 4


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, by which packets and buckets grow with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def plain_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that any bits of the result can serve as a bucket."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out *= np.uint64(MULTIPLIER)
        out += words[k : k + count]
    return mixed(out)


def packets(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns with the packet of each row's ``doc_id``."""
    many = PACKETS_PER_PARTITION * partitions(docs.sparkSession)
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int").alias("packet"), *columns)


class Asked:
    """Distinct truncated keys of one packet, in bucket order; ``at`` maps each key given to its entry."""

    def __init__(self, keys: np.ndarray, buckets: int):
        whole = ((keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        self.distinct, self.at, self.counts = np.unique(whole, return_inverse=True, return_counts=True)
        self.edges = np.searchsorted(self.distinct, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        self.buckets = buckets

    def rows(self, packet: int, flags: np.ndarray | None = None) -> pa.Table:
        """One question for every bucket that has keys; ``flags`` is a byte for each distinct key."""
        low = (self.distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
        counts = np.minimum(self.counts, 0xFFFFFFFF).astype("<u4")
        if flags is None:
            flags = np.zeros(0, np.uint8)
        spans = [(b, int(s), int(e)) for b, (s, e) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)) if e > s]
        return pa.table({
            "packet": pa.array([packet] * len(spans), pa.int32()),
            "bucket": pa.array([b for b, _, _ in spans], pa.int32()),
            "keys": pa.array([low[s:e].tobytes() for _, s, e in spans], pa.binary()),
            "counts": pa.array([counts[s:e].tobytes() for _, s, e in spans], pa.binary()),
            "flags": pa.array([flags[s:e].tobytes() for _, s, e in spans], pa.binary()),
        })

    def answers(self, replies: pa.Table) -> np.ndarray:
        """The replies of all buckets, as one byte for each key given."""
        out = np.zeros(len(self.distinct), np.uint8)
        for bucket, reply in zip(replies["bucket"].to_pylist(), replies["reply"].to_pylist(), strict=True):
            out[self.edges[bucket] : self.edges[bucket + 1]] = np.frombuffer(reply, np.uint8)
        return out[self.at]


QUESTION = "packet int, bucket int, keys binary, counts binary, flags binary"
REPLY = "packet int, bucket int, reply binary"


def answered(questions: DataFrame, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """For every question a byte per key: ``judge`` gets the corpus-wide count of each key
    and the union of its flags. A bucket's keys are four bytes each and there are as many
    buckets as shuffle partitions, so a group is a small, data-independent share."""

    def meet(group: pa.Table) -> pa.Table:
        blobs = group["keys"].to_pylist()
        keys = np.frombuffer(b"".join(blobs), "<u4")
        counts = np.frombuffer(b"".join(group["counts"].to_pylist()), "<u4")
        flags = np.frombuffer(b"".join(group["flags"].to_pylist()), np.uint8)
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(distinct))
        union = np.zeros(len(distinct), np.uint8)
        if len(flags):
            np.bitwise_or.at(union, at, flags)
        verdict = judge(total, union).astype(np.uint8)[at].tobytes()
        replies, start = [], 0
        for blob in blobs:
            replies.append(verdict[start : start + len(blob) // 4])
            start += len(blob) // 4
        return pa.table({
            "packet": group["packet"].combine_chunks(), "bucket": group["bucket"].combine_chunks(),
            "reply": pa.array(replies, pa.binary()),
        })

    return questions.groupBy("bucket").applyInArrow(meet, REPLY)


def by_row(run: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema, rows: int = 256):
    """A mapInArrow function that hands ``run`` small slices of a batch, so that one slice's
    scratch memory stays small however long the texts are."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                got = run({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(got, schema=schema)

    return mapped
