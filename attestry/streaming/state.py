"""The state store that keyed processors need."""

from __future__ import annotations

from pyspark.sql import SparkSession


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk, with changes per batch, rather than in memory."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
