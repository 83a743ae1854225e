"""Loaders for Parquet tables: only the named columns, zoneless times made instants; tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str, *, spread_by: str | None = None) -> DataFrame:
    """Read a table. With ``spread_by``, one that comes in fewer splits than there are
    cores is hashed over them; a table of many splits is left as scanned."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    if zoneless:
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
    if spread_by:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores, spread_by)
    return df


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, of one file or a folder of many, its columns as they are stored.

    A stream's path names a folder unless it is a pattern: the braces make it one.
    """
    folder = folder.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}.parquet}}")
