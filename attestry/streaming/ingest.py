"""Pages as they arrive: the raw row is stored before anything derived from it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.segment import source_units
from ..operators.urls import url_canonicalize
from ..sources.pages import page_extract
from .state import use_rocksdb

def page_stream(spark: SparkSession, folder: str, schema: StructType, *, glob: str = "*.parquet",
                files_per_trigger: int = 1000) -> DataFrame:
    """Arriving page files; the file's own time is the event time."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
        .select("*", F.col("_metadata.file_modification_time").alias("arrived_at"))
    )


class FirstCopy(StatefulProcessor):
    """Passes on the first copy of a URL and remembers that it did: one flag per URL."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "stored boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.stored.exists(), None
        for batch in rows:
            if known:
                continue  # the copies that are left are read, not kept
            for n, (at, page) in enumerate(zip(batch["arrived_at"], batch["page_id"], strict=True)):
                order = (at, not pd.isna(page), page)
                if best is None or order < best[0]:
                    best = order, batch.iloc[[n]]
        if best is not None:
            self.stored.update((True,))
            yield best[1]

    def close(self) -> None:
        pass


def first_copies(pages: DataFrame) -> DataFrame:
    """Of a stream of pages, the copy to store of each URL that never came before: the earliest,
    and the smallest ``page_id`` among those that arrived together."""
    fine = url_canonicalize(pages).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return fine.groupBy("canonical").transformWithStateInPandas(
        statefulProcessor=FirstCopy(), outputStructType=fine.schema, outputMode="Append", timeMode="None")


def stream_page_ingest(pages: DataFrame, target: str, *, available_now: bool = True) -> StreamingQuery:
    """Write ``raw`` and then ``units`` under ``target``.

    A URL is stored once for all time: a flag per URL is the state, kept where the URL is
    hashed to, so a batch costs what arrives in it, however many URLs came before, and no
    watermark lets a URL in again. Each batch owns its folders and overwrites them, so a
    batch replayed after a failure, from the state before it, leaves the same files; units
    are cut from the stored raw rows.
    """
    use_rocksdb(pages.sparkSession)
    new = first_copies(pages)

    def store(batch: DataFrame, batch_id: int) -> None:
        raw = f"{target}/raw/batch={batch_id}"
        batch.write.mode("overwrite").parquet(raw)
        stored = batch.sparkSession.read.schema(new.schema).parquet(raw)
        texts = page_extract(stored).filter("success").select("page_id", F.col("canonical").alias("url"), "text")
        source_units(texts).write.mode("overwrite").parquet(f"{target}/units/batch={batch_id}")

    writer = new.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", f"{target}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
