"""Run counters and latest state over a stream of progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DAY = "1 day"


def run_progress(events: DataFrame, *, window: str = DAY) -> DataFrame:
    """(run_id, ts, event_id, state, ok) → counters per run and tumbling window.

    The same function serves a batch and a stream.
    """
    return (
        events.groupBy("run_id", F.window("ts", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if("ok").alias("succeeded"),
            F.count_if(~F.col("ok")).alias("failed"),
            F.max(F.struct("ts", "event_id", "state")).alias("last"),
        )
        .select(
            "run_id", F.unix_seconds("w.start").alias("began"),
            "events", "succeeded", "failed", F.col("last.state").alias("latest_state"),
        )
    )


def stream_run_progress(events: DataFrame, target: str, *, window: str = DAY, lateness: str = "2 hours",
                        available_now: bool = True) -> StreamingQuery:
    """Updated counters of every batch under ``target``; ``latest_progress`` reads them."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/progress/batch={batch_id}")

    writer = (
        run_progress(events.withWatermark("ts", lateness), window=window)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", f"{target}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_progress(spark: SparkSession, target: str) -> DataFrame:
    """The newest counters of each run and window (``began``, its first second)."""
    rows = spark.read.parquet(f"{target}/progress")
    counters = F.struct("events", "succeeded", "failed", "latest_state")
    return rows.groupBy("run_id", "began").agg(F.max_by(counters, "batch").alias("c")).select("run_id", "began", "c.*")
