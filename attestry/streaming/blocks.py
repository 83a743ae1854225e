"""Caption blocks over unbounded captions, in event-time order.

Captions wait in state until the watermark has passed them, are then taken in time
order, and close blocks by the batch rule: a block ends before a caption that starts
``span`` after the block's own start or would make its text too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from .state import use_rocksdb

BUCKET_SECONDS = 60
SHARDS = 1024
OUTPUT_ROWS = 10_000
OUTPUT = "video_id long, start_ms long, n_captions int, text string"
OPEN = pa.schema([("video_id", pa.int64()), ("start_ms", pa.int64()), ("n_captions", pa.int64()), ("text", pa.large_string())])
WAITING = pa.schema([("video_id", pa.int64()), ("at_ms", pa.int64()), ("pos", pa.int64()), ("text", pa.large_string())])


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, schema.types)], schema=schema)


def _value(batch: pa.RecordBatch) -> tuple[bytes]:
    return (batch.serialize().to_pybytes(),)


def _table(values: list[tuple[bytes]], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(value[0]), schema) for value in values], schema)


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(column.to_numpy().tolist() for column in table.columns))


class BlockProcessor(StatefulProcessor):
    """Open blocks and waiting captions of one key: a shard of videos or, where the rows name
    none, the video that is the key.

    Captions wait in pieces, those of one bucket of ``bucket_ms`` that arrived together. A piece is
    written once and read once, when the watermark has passed its bucket; a key waits for one timer,
    at the first end of a bucket or an open block. Every access to state is a call out of Python, so
    a key costs few of them. Pieces and open blocks are kept as the bytes of record batches.
    """

    def __init__(self, span_ms: int, chars: int, bucket_ms: int) -> None:
        self.span_ms, self.chars, self.bucket_ms = span_ms, chars, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "blocks binary")
        self.kept = handle.getValueState("kept", "pieces long, wake_ms long")
        self.waiting = handle.getMapState("waiting", "bucket long, piece long", "captions binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces, wake = self.kept.get() or (0, None)
        ends = set() if wake is None else {wake}
        for batch in rows:
            videos = batch["video_id"].astype("int64").to_numpy() if "video_id" in batch else np.full(len(batch), key[0])
            at, pos = (batch[c].astype("int64").to_numpy() for c in ("at_ms", "pos"))
            arrived, buckets = _batch((videos, at, pos, batch["text"].tolist()), WAITING), at // self.bucket_ms
            for bucket in np.unique(buckets).tolist():
                self.waiting.updateValue((bucket, pieces), _value(arrived.filter(pa.array(buckets == bucket))))
                ends.add(self._end(bucket))
                pieces += 1
        self._keep(pieces, wake, ends)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No caption before ``reached`` waits after this call, and none can still come.
        reached = timerValues.getCurrentWatermarkInMs() // self.bucket_ms * self.bucket_ms
        pieces, wake = self.kept.get()
        if wake is None or wake > reached:
            return  # an earlier timer has done the work of this one
        held = self.open.get()
        blocks = {video: block for video, *block in _rows(_table([held], OPEN))} if held else {}
        done, ends = [], set()
        for bucket, keys in groupby(sorted(self.waiting.keys()), lambda k: k[0]):
            if self._end(bucket) > reached:
                ends.add(self._end(bucket))
                break
            keys = list(keys)
            captions = _table([self.waiting.getValue(k) for k in keys], WAITING)
            for video, at, _, text in _rows(captions.sort_by([(name, "ascending") for name in WAITING.names])):
                block = blocks.get(video)
                if block and (at - block[0] >= self.span_ms or len(block[2]) + len(text) > self.chars):
                    done.append((video, *block))
                    block = None
                blocks[video] = (block[0], block[1] + 1, block[2] + " " + text) if block else (at, 1, text)
            for k in keys:
                self.waiting.removeKey(k)
            if len(done) >= OUTPUT_ROWS:
                yield self._closed(done)
                done = []
        for video, block in list(blocks.items()):
            if reached >= block[0] + self.span_ms:
                done.append((video, *blocks.pop(video)))
        if done:
            yield self._closed(done)
        if blocks:
            self.open.update(_value(_batch(zip(*((video, *block) for video, block in blocks.items())), OPEN)))
            ends.add(self._end((min(block[0] for block in blocks.values()) + self.span_ms - 1) // self.bucket_ms))
        else:
            self.open.clear()
        self._keep(pieces, wake, ends)

    def _end(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket_ms

    def _keep(self, pieces: int, wake: int | None, ends: set[int]) -> None:
        """Keep the number of pieces written, and wake at the first of ``ends``."""
        first = min(ends, default=None)
        if first is not None and first != wake:
            self.handle.registerTimer(first)
        self.kept.update((pieces, first))

    def _closed(self, done: list[tuple[int, int, int, str]]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(OPEN.names, map(list, zip(*done)))))

    def close(self) -> None:
        pass


def caption_block_stream(captions: DataFrame, *, span: int, chars: int, lateness: str, shards: int = SHARDS) -> DataFrame:
    """(video_id, ts, pos, text) stream → closed blocks.

    Videos are dealt to ``shards`` keys, as each key costs calls and frames of its own, however few
    its captions are. They wait about as long as ``lateness``: a bucket is an eighth of it, so a
    shard holds few buckets however long it is, and blocks come out at most a bucket after the
    watermark. A task holds one bucket of one shard at a time. A checkpoint belongs to one
    ``span``, ``lateness`` and ``shards``.
    """
    timed = captions.withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64("video_id"), F.lit(shards)).alias("shard"), "video_id", "ts", F.unix_millis("ts").alias("at_ms"), "pos", "text"
    )
    wait = captions.sparkSession.range(1).select(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.lit(lateness).cast("interval"))).first()[0] // 8
    return timed.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=BlockProcessor(span * 1000, chars, max(span, BUCKET_SECONDS, wait) * 1000),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_caption_blocks(captions: DataFrame, target: str, *, span: int = 35, chars: int = 1000,
                          lateness: str = "10 minutes", shards: int = SHARDS, available_now: bool = True) -> StreamingQuery:
    """Append closed blocks to ``target``/blocks. Needs the RocksDB state store."""
    use_rocksdb(captions.sparkSession)
    writer = (
        caption_block_stream(captions, span=span, chars=chars, lateness=lateness, shards=shards)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{target}/blocks")
        .option("checkpointLocation", f"{target}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class LateCaptions(StreamingQueryListener):
    """Captions left out because the watermark had passed them when they came, summed over all
    batches of every query: ``spark.streams.addListener(LateCaptions())`` before it starts. A
    report that is delivered twice counts once."""

    def __init__(self) -> None:
        self.dropped: dict[str, dict[int, int]] = {}

    def count(self, query: StreamingQuery) -> int:
        return sum(self.dropped.get(str(query.runId), {}).values())

    def onQueryProgress(self, event) -> None:
        report = event.progress
        late = sum(state.numRowsDroppedByWatermark for state in report.stateOperators)
        if late:
            self.dropped.setdefault(str(report.runId), {})[report.batchId] = late

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_captions(query: StreamingQuery) -> int:
    """Late captions over the reports the query keeps
    (``spark.sql.streaming.numRecentProgressUpdates``); ``LateCaptions`` counts all."""
    return sum(state.numRowsDroppedByWatermark for report in query.recentProgress for state in report.stateOperators)
