"""Training-order materialisation of token ids.

Every document is tokenized and cut into sequences of ``length`` token ids (its last one
is filled up with ``pad``). Sequences are numbered densely; a keyed Feistel permutation
over the next power of four, walked along its cycle until it falls below the number of
sequences, gives each a global slot. The permutation is a bijection, so no shuffle buffer,
no sort by random keys and no table of the order is needed: slot and sequence number can
be computed from each other. Range partitions by slot write shards of fixed stride: record
k of a shard starts at byte k * stride, so training reads shards sequentially and resumes
at any slot by arithmetic.

Defined results: a null or empty text has no sequence. Rows are independent; repeated rows
are separate sequences. Documents with a null doc_id come last in number order. Extra columns are
ignored. An empty table gives no shards.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

ROUNDS = 6
PAD = 50256
DTYPE = "<u2"
#: Hash classes of documents, and the most groups of cells that have a running total of their own.
CELLS, GROUPS = 1 << 20, 1 << 10


class Feistel:
    """A keyed bijection of 0..size-1."""

    def __init__(self, size: int, key: str):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(29)) & self.mask

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return (right << np.uint64(self.half)) | left

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (over := out >= np.uint64(self.size)).any():
            out[over] = self._once(out[over], keys)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: the halves are swapped at the end of a pass, so it runs with the keys reversed."""
        return self._walk(slots, self.keys[::-1])


class Ranges:
    """Bijections of consecutive ranges of ``span`` numbers, each onto itself and with a key of its own."""

    def __init__(self, size: int, span: int, key: str):
        self.size, self.span, self.key = size, span, key

    def _each(self, x: np.ndarray, way: str) -> np.ndarray:
        x = np.asarray(x, np.int64)
        out = np.empty(len(x), np.int64)
        ranges = x // self.span
        for k in np.unique(ranges).tolist():
            own, start = ranges == k, k * self.span
            order = Feistel(min(self.span, self.size - start), f"{self.key}:{k}")
            out[own] = start + getattr(order, way)(x[own] - start)
        return out

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._each(numbers, "slots")

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._each(slots, "numbers")


def encoder(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, path: str, length: int, place: tuple[str, str] | None = None) -> DataFrame:
    """One row for each document that has tokens: doc_id, cell (a hash class of documents, or
    the first column of ``place``), inside (0, or the second one), many (its sequences),
    n_tokens and tokens (its ids, compressed until they are placed)."""

    def encode(batches):
        coder, codec = encoder(path), pa.Codec("zstd")
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids, kept = [], []
                for row, text in enumerate(part["text"].to_pylist()):
                    if text and (found := coder.encode_ordinary(text)):
                        kept.append(row)
                        ids.append(found)
                counts = [len(x) for x in ids]
                many = [-(-n // length) for n in counts]
                blobs = [codec.compress(np.array(found, DTYPE).tobytes(), asbytes=True) for found in ids]
                picked = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [picked["doc_id"], picked["cell"], picked["inside"], pa.array(many, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    ["doc_id", "cell", "inside", "many", "n_tokens", "tokens"])

    cell, inside = (F.col(c) for c in place) if place else (F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)), F.lit(0))
    return docs.select("doc_id", cell.cast("long").alias("cell"), inside.cast("long").alias("inside"), "text").mapInArrow(
        encode, "doc_id long, cell long, inside long, many long, n_tokens long, tokens binary")


def materialise(docs: DataFrame, path: str, *, length: int = 1024, key: str = "order-1", per_shard: int = 4096,
                per_record: int = 64, place: tuple[str, str] | None = None, within: int | None = None) -> DataFrame:
    """Fixed-stride shards of ``docs`` (doc_id, text) in training order.

    Sequences are numbered by a hash class of their document, or by the two whole-number
    columns ``place`` of ``docs`` (a dense one, then the place within it). All are permuted
    together, or, with ``within``, each range of so many numbers on its own, which keeps
    the order of ``place`` from range to range.

    One row for each record of ``per_record`` slots: shard, first_slot, slots, stride (bytes
    of one sequence), doc_ids, parts (number of the sequence in its document), lengths (real
    tokens), payload (slots * stride bytes) and payload_sha256. Rows are written by range of
    first_slot, so files are shards in order.
    """
    spark = docs.sparkSession
    where = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    sequences(docs, path, length, place).write.parquet(where)
    known = spark.read.parquet(where)
    size, most = (int(x) for x in known.agg(F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.max("cell"), F.lit(0))).first())
    if not size:
        return spark.createDataFrame([], SHARD)
    # Dense numbers: cells in order, then documents within a cell. Running totals are taken
    # within groups of cells and over at most 1024 groups, so no window sees all cells.
    cells = known.groupBy("cell").agg(F.sum("many").alias("total")).withColumn("together", F.floor(F.col("cell") / -(-(most + 1) // GROUPS)))
    groups = cells.groupBy("together").agg(F.sum("total").alias("sum"))
    before = groups.select("together", (F.sum("sum").over(W.orderBy("together")) - F.col("sum")).alias("before"))
    upto = W.partitionBy("together").orderBy("cell")
    base = cells.withColumn("upto", F.sum("total").over(upto)).join(before, "together").select(
        "cell", (F.col("before") + F.col("upto") - F.col("total")).alias("base"))
    inside = W.partitionBy("cell").orderBy("inside", F.col("doc_id").asc_nulls_last(), "n_tokens", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = known.select("doc_id", "cell", "inside", "many", "n_tokens", F.xxhash64("tokens").alias("row"), F.col("tokens"))
    numbered = rows.join(base, "cell").withColumn("first", F.col("base") + F.sum("many").over(inside) - F.col("many"))
    order = Ranges(size, within, key) if within else Feistel(size, key)
    stride = length * np.dtype(DTYPE).itemsize
    fill = np.full(length, PAD, DTYPE).tobytes()

    def place(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids, parts, lengths, blobs, numbers = [], [], [], [], []
                for doc, first, many, n, blob in zip(*(part[c].to_pylist() for c in ("doc_id", "first", "many", "n_tokens", "tokens")), strict=True):
                    whole = codec.decompress(blob, 2 * n, asbytes=True) + fill[: 2 * (many * length - n)]
                    for k in range(many):
                        ids.append(doc)
                        parts.append(k)
                        numbers.append(first + k)
                        lengths.append(min(length, n - k * length))
                        blobs.append(whole[k * stride : (k + 1) * stride])
                slots = order.slots(np.array(numbers, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots // per_record, pa.int64()), pa.array(slots, pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())], ["record", "slot", "doc_id", "part", "length", "ids"])

    placed = numbered.mapInArrow(place, "record long, slot long, doc_id long, part long, length long, ids binary")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Slots are dense, so equal ranges of records are equal shares: no sampling pass is needed.
    share = -(-size // per_record) / width
    ranged = placed.repartition(width, F.floor(F.col("record") / F.lit(share))).sortWithinPartitions("slot")

    def pack(batches):
        def record(rows):
            payload = b"".join(r[5] for r in rows)
            return (rows[0][1] // per_shard, rows[0][1], len(rows), stride, [r[2] for r in rows], [r[3] for r in rows],
                    [r[4] for r in rows], payload, hashlib.sha256(payload).hexdigest())

        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[0][0] != row[0]:
                    yield _packed([record(held)])
                    held = []
                held.append(row)
        if held:
            yield _packed([record(held)])

    return ranged.mapInArrow(pack, SHARD)


SHARD = ("shard long, first_slot long, slots long, stride long, doc_ids array<long>, parts array<long>, lengths array<long>, "
         "payload binary, payload_sha256 string")
SHARD_ARROW = pa.schema([
    ("shard", pa.int64()), ("first_slot", pa.int64()), ("slots", pa.int64()), ("stride", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("parts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()), ("payload_sha256", pa.string())])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SHARD_ARROW, strict=True)], schema=SHARD_ARROW)


def write_shards(shards: DataFrame, folder: str) -> None:
    """Write shards as files of one table, partitioned by shard."""
    shards.write.mode("overwrite").partitionBy("shard").parquet(folder)


def read_from(spark: SparkSession, folder: str, slot: int, until: int | None = None, per_record: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Sequences in slot order from ``slot`` on: only records from there are read, one shard at a time."""
    rows = spark.read.parquet(folder).filter(F.col("first_slot") > slot - per_record)
    if until is not None:
        rows = rows.filter(F.col("first_slot") < until)
    for row in rows.select("first_slot", "slots", "stride", "payload").orderBy("first_slot").toLocalIterator():
        for k in range(row["slots"]):
            at = row["first_slot"] + k
            if at >= slot and (until is None or at < until):
                yield at, np.frombuffer(row["payload"], DTYPE, row["stride"] // 2, k * row["stride"])

