"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (label 1) and unlabelled text train a linear classifier over
hashed byte 5-grams with the class-prior-corrected, non-negative risk

    prior * E_p[loss(f, +1)] + max(0, E_u[loss(f, -1)] - prior * E_p[loss(f, -1)])

with logistic loss. When the corrected negative risk falls below zero the step goes back
up on it, so that the classifier cannot fit unlabelled text as negative without limit.
Training uses bounded, hash-chosen samples (``positives``, ``unlabelled``); scoring covers
every text whole.

Defined results: rows without words score like a text without any evidence (the bias).
Repeated rows score alike. A null doc_id is not held out. With no confirmed example the
prior alone is the score. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, BUCKETS_LOG2 = 5, 20
BUCKETS = 1 << BUCKETS_LOG2
SEGMENTS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else (32 if c in b"\t\n\r\v\f.,;:!?" else c) for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every byte 5-gram of the texts laid end to end; grams do not cross texts."""
    data = [b" " + (t or "").encode("utf-8", "surrogatepass").translate(LOWER) + b" " for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    count = len(flat) - GRAM + 1
    if count <= 0:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    value = flat[:count].copy()
    for k in range(1, GRAM):
        value = (value << np.uint64(8)) | flat[k : k + count]
    buckets = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)
    rows = np.repeat(np.arange(len(data), dtype=np.int32), sizes)
    inside = rows[:count] == rows[GRAM - 1 :]
    return buckets[inside], rows[:count][inside]


def _present(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs."""
    buckets, rows = gram_buckets(texts)
    both = np.unique(rows.astype(np.int64) << BUCKETS_LOG2 | buckets)
    return both >> BUCKETS_LOG2, both & (BUCKETS - 1)


def training_sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """(positive, text) rows of both samples, and the class prior.

    Both samples are chosen by hash with a rate that makes them about the given size; the
    confirmed ids that are broadcast are therefore at most a small multiple of
    ``positives``, which is checked.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    prior = min(0.9, max(1e-3, known["p"] / known["n"])) if known["n"] else 1e-3
    part = lambda rate: F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, rate) * (1 << 30))
    chosen = usable.filter((F.col("toxic") == 1) & part(positives / max(1, known["p"]))).select("doc_id").distinct()
    if chosen.count() > 2 * positives:
        raise ValueError("the sample of confirmed examples is larger than its bound")
    training = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    many = docs.count()
    confirmed = training.join(F.broadcast(chosen), "doc_id").select(F.lit(1).alias("positive"), "text")
    plain = training.filter(part(unlabelled / max(1, many))).select(F.lit(0).alias("positive"), "text")
    return confirmed.unionByName(plain), prior


def _frequencies(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that hold each bucket, and documents of each class."""
    span = BUCKETS // SEGMENTS

    def count(batches):
        held, docs = np.zeros((2, BUCKETS), np.uint32), np.zeros(2, np.int64)
        for batch in batches:
            kinds = batch["positive"].to_numpy()
            texts = batch["text"].to_pylist()
            for start in range(0, len(texts), 128):
                rows, buckets = _present(texts[start : start + 128])
                kind = kinds[start : start + 128]
                for k in (0, 1):
                    np.add.at(held[k], buckets[kind[rows] == k], 1)
                    docs[k] += int((kind == k).sum())
        parts = [(s, held[:, s * span : (s + 1) * span]) for s in range(SEGMENTS) if held[:, s * span : (s + 1) * span].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in parts] + [SEGMENTS], pa.int32()), pa.array([np.ascontiguousarray(h).tobytes() for _, h in parts] + [docs.tobytes()], pa.binary())],
            ["segment", "held"])

    def add(group: pa.Table) -> pa.Table:
        segment = group["segment"][0].as_py()
        kind = np.int64 if segment == SEGMENTS else np.uint32
        total = None
        for blob in group["held"].to_pylist():
            value = np.frombuffer(blob, kind)
            total = value.copy() if total is None else total + value
        return pa.table({"segment": pa.array([segment], pa.int32()), "held": pa.array([total.tobytes()], pa.binary())})

    schema = "segment int, held binary"
    held, docs = np.zeros((2, BUCKETS), np.uint32), np.zeros(2, np.int64)
    for row in sample.mapInArrow(count, schema).groupBy("segment").applyInArrow(add, schema).collect():
        if row["segment"] == SEGMENTS:
            docs = np.frombuffer(row["held"], np.int64)
        else:
            held[:, row["segment"] * span : (row["segment"] + 1) * span] = np.frombuffer(row["held"], np.uint32).reshape(2, span)
    return held, docs


def train(rows: np.ndarray, features: np.ndarray, positive: np.ndarray, width: int, prior: float, *,
          steps: int = 400, rate: float = 0.1, decay: float = 1e-3, below: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk; (rows, features) are the
    present features of the training texts."""
    many = len(positive)
    is_p, is_u = positive == 1, positive == 0
    n_p, n_u = max(1, is_p.sum()), max(1, is_u.sum())
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        f = bias + np.bincount(rows, weights=w[features], minlength=many)
        p = 1 / (1 + np.exp(-np.clip(f, -60, 60)))
        negative_loss = np.logaddexp(0, f)
        corrected = negative_loss[is_u].sum() / n_u - prior * negative_loss[is_p].sum() / n_p
        grad_negative = np.where(is_u, p / n_u, -prior * p / n_p)
        if corrected >= below:
            grad = np.where(is_p, -prior * (1 - p) / n_p, 0.0) + grad_negative
        else:
            grad = -grad_negative
        whole = np.append(np.bincount(features, weights=grad[rows], minlength=width) + decay * w / width, grad.sum())
        m = 0.9 * m + 0.1 * whole
        v = 0.999 * v + 0.001 * whole**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = 4000, unlabelled: int = 12000, width: int = 8192, least: float = 4.0) -> tuple[np.ndarray, float]:
    """A weight for every bucket and the bias. Only the ``width`` buckets that are the most
    over-represented in confirmed text get a weight: presence of toxic material is evidence,
    its absence is not."""
    table = np.zeros(BUCKETS, np.float32)
    sample, prior = training_sample(docs, labels, positives, unlabelled)
    held, many = _frequencies(sample)
    if not many[1]:
        return table, float(np.log(prior / (1 - prior)))
    p, u = held[1] / max(1, many[1]), held[0] / max(1, many[0])
    # A bucket is evidence where even the low end of its share among confirmed texts is
    # several times the high end of its share among unlabelled text.
    low = p - 2 * np.sqrt(p * (1 - p) / max(1, many[1]))
    high = u + 2 * np.sqrt(u * (1 - u) / max(1, many[0])) + 1 / max(1, many[0])
    strength = np.where(held[1] >= 3, low / high, 0.0)
    chosen = np.argsort(-strength, kind="stable")[:width]
    chosen = np.sort(chosen[strength[chosen] > least])
    slot = np.full(BUCKETS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))

    def select(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            lists: list[np.ndarray] = []
            for start in range(0, len(texts), 128):
                some = texts[start : start + 128]
                rows, buckets = _present(some)
                found = slot[buckets]
                rows, found = rows[found >= 0], found[found >= 0]
                edges = np.searchsorted(rows, np.arange(len(some) + 1))
                lists += [found[s:e].astype("<i4").tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(lists, pa.binary())], ["positive", "features"])

    got = sorted((r["positive"], bytes(r["features"])) for r in sample.mapInArrow(select, "positive int, features binary").collect())
    positive = np.array([k for k, _ in got], np.int64)
    features = [np.frombuffer(b, "<i4") for _, b in got]
    rows = np.repeat(np.arange(len(features)), [len(x) for x in features])
    w, bias = train(rows, np.concatenate(features).astype(np.int64), positive, len(chosen), prior)
    table[chosen] = np.maximum(w, 0.0)
    # A text without any evidence is never likelier than the prior.
    return table, min(bias, float(np.log(prior / (1 - prior))))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    table, bias = fit(docs, labels, **bounds)
    weights = docs.sparkSession.sparkContext.broadcast(table)

    def score(batches):
        w = weights.value
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                buckets, rows = gram_buckets(part["text"].to_pylist())
                heavy = w[buckets] > 0
                both = np.unique(rows[heavy].astype(np.int64) << BUCKETS_LOG2 | buckets[heavy])
                f = bias + np.bincount(both >> BUCKETS_LOG2, weights=w[both & (BUCKETS - 1)], minlength=part.num_rows)
                value = 1 / (1 + np.exp(-np.clip(f, -60, 60)))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(value, pa.float64()), pa.array((value >= threshold).astype(np.int32), pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int")
