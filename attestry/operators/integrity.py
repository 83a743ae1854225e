"""Content manifests and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import stays_inside

SCHEMA_TAG = "attestry.evidence.v1"
#: Files that a bundle's header names, by the column that has their hash.
LINKED = {"transcript_sha256": "transcript.json", "report_sha256": "evidence.html", "capture_sha256": "capture.json"}


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def content_manifest(df: DataFrame, *, name: str = "name", content: str = "content") -> DataFrame:
    """(name, sha256) of every row."""
    return df.select(F.col(name).cast("string").alias("name"), sha256(F.col(content)).alias("sha256"))


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, sha256) of the files under a folder, read and hashed by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", r"\A.*?" + r"\Q" + folder.rstrip("/") + r"/\E", "")
    return files.select(relative.alias("name"), F.sha2("content", 256).alias("sha256"))


def _entries_hash(entry: Column) -> tuple[list[Column], Column]:
    """An order-free hash over entry hashes: their words are added up as numbers, so that it is
    a plain aggregate. Gives the aggregates and the hash of their results."""
    word = lambda at: F.conv(F.substring(entry, at, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(word(i * 8 + 1)).alias(f"w{i}") for i in range(8)]
    return sums, F.sha2(F.concat_ws(" ", *[F.col(f"w{i}").cast("string") for i in range(8)]), 256)


def manifest_header(manifest: DataFrame) -> DataFrame:
    """One row: schema tag, entry count and an order-free hash over all entries."""
    entries = manifest.select(F.sha2(F.concat_ws(" ", "sha256", "name"), 256).alias("h"))
    sums, whole = _entries_hash(F.col("h"))
    return entries.agg(F.count(F.lit(1)).alias("entries"), *sums).select(
        F.lit(SCHEMA_TAG).alias("schema_tag"), "entries", whole.alias("header_sha256"))


def records_hash(records: DataFrame, bundle: str = "video_id") -> DataFrame:
    """(bundle, entries, records_sha256) of evidence records, whatever their order."""
    sums, whole = _entries_hash(F.sha2(F.to_json(F.struct("*")), 256))
    return records.groupBy(bundle).agg(F.count(F.lit(1)).alias("entries"), *sums).select(bundle, "entries", whole.alias("records_sha256"))


def bundle_header(records: DataFrame, files: DataFrame, bundle: str = "video_id") -> DataFrame:
    """One row per bundle of evidence records: (bundle, schema_tag, entries, records_sha256) and
    the hash of its transcript, report and capture file, NULL where ``files`` (bundle, name,
    sha256) has none."""
    named = [F.max(F.when(F.col("name") == name, F.col("sha256"))).alias(column) for column, name in LINKED.items()]
    heads = records_hash(records, bundle).join(files.groupBy(bundle).agg(*named), bundle, "left")
    return heads.select(bundle, F.lit(SCHEMA_TAG).alias("schema_tag"), "entries", "records_sha256", *LINKED)


def bundle_verify(headers: DataFrame, records: DataFrame, files: DataFrame, bundle: str = "video_id") -> DataFrame:
    """Errors (bundle, name, error) of evidence bundles, walking from a bundle's header to its
    records and from those to the files they name.

    ``headers`` are rows of ``bundle_header`` as saved, ``records`` (bundle, frame_file,
    frame_sha256, ...) and ``files`` (bundle, name, sha256) what is there now. Records that no
    longer match their header, or a header of another schema, are a bundle's only error, as
    nothing that they say can be trusted. Every file is checked once, however many records
    name it; a path that leaves the bundle is unsafe; only the transcript must exist.
    """
    now = records_hash(records, bundle).select(bundle, F.col("records_sha256").alias("_now"))
    levels = headers.join(now, bundle, "left").withColumn(
        "_bad",
        F.when(F.coalesce("_now", F.lit("")) != F.coalesce("records_sha256", F.lit("")), F.struct(F.lit("(records)").alias("name"), F.lit("hash mismatch").alias("error")))
        .when(F.coalesce("schema_tag", F.lit("")) != SCHEMA_TAG, F.struct(F.lit("(header)").alias("name"), F.lit("unsupported schema").alias("error"))))
    top = levels.filter("_bad is not null").select(bundle, "_bad.*")
    sound = levels.filter("_bad is null")
    linked = F.array(*(F.struct(F.lit(name).alias("name"), F.col(column).alias("sha256")) for column, name in LINKED.items()))
    named = sound.select(bundle, F.explode(linked).alias("_f")).select(bundle, "_f.*")
    absent = named.filter(F.col("sha256").isNull() & (F.col("name") == LINKED["transcript_sha256"])).select(
        bundle, "name", F.lit("transcript unavailable").alias("error"))
    frames = records.join(sound.select(bundle), bundle, "left_semi").select(bundle, F.col("frame_file").alias("name"), F.col("frame_sha256").alias("sha256"))
    asked = frames.unionByName(named.filter("sha256 is not null")).distinct()
    seen = files.select(bundle, "name", F.col("sha256").alias("_now"))
    error = (
        F.when(F.col("name").isNull() | ~stays_inside(F.col("name")) | F.col("_now").isNull(), "missing or unsafe")
        .when(~F.col("_now").eqNullSafe(F.col("sha256")), "hash mismatch")
    )
    walked = asked.join(seen, [bundle, "name"], "left").select(bundle, "name", error.alias("error")).filter("error is not null").distinct()
    return top.unionByName(absent).unionByName(walked)


def manifest_verify(manifest: DataFrame, actual: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Errors (name, error) of a manifest against the actual (name, sha256) rows.

    With a one-row ``header``, a header that does not match or has another schema is the
    only error reported.
    """
    seen = actual.select("name", F.col("sha256").alias("_now"))
    compared = manifest.select("name", "sha256").join(seen, "name", "left")
    error = (
        F.when(~stays_inside(F.col("name")) | F.col("_now").isNull(), "missing or unsafe")
        .when(F.col("_now") != F.col("sha256"), "hash mismatch")
    )
    errors = compared.withColumn("error", error).filter(F.col("error").isNotNull()).select("name", "error")
    if header is None:
        return errors
    # One-row tables are read as scalar subqueries, so nothing is joined to them.
    stored, tag = header.select("header_sha256").scalar(), header.select("schema_tag").scalar()
    verdict = (
        F.when(stored.isNull() | (stored != F.col("header_sha256")), "hash mismatch")
        .when(tag != SCHEMA_TAG, "unsupported schema")
    )
    status = manifest_header(manifest).select(verdict.alias("bad"))
    broken = status.filter(F.col("bad").isNotNull()).select(F.lit("(header)").alias("name"), F.col("bad").alias("error"))
    return errors.filter(status.scalar().isNull()).unionByName(broken)
