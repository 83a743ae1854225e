"""Evidence bundles: whatever single thing is altered gives exactly one error."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attestry.operators import integrity as I

SHA = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a", "b", "t", "r", "c")}
RECORD = "video_id long, evidence_id string, frame_file string, frame_sha256 string, summary string"


@pytest.fixture(scope="module")
def saved(spark):
    records = spark.createDataFrame(
        [(v, f"E{n}", f"frames/{f}.jpg", SHA[f], "text") for v in (1, 2) for n, f in enumerate("aabb")] + [(2, "E9", "frames/a.jpg", SHA["a"], None)], RECORD)
    names = {"frames/a.jpg": "a", "frames/b.jpg": "b", "transcript.json": "t", "evidence.html": "r", "capture.json": "c", "unnamed.txt": "c"}
    files = spark.createDataFrame([(v, n, SHA[x]) for v in (1, 2) for n, x in names.items()], "video_id long, name string, sha256 string")
    return I.bundle_header(records, files).cache(), records, files


def errors(*tables):
    return sorted(tuple(r) for r in I.bundle_verify(*tables).collect())


def test_untouched_bundles_have_no_errors(saved):
    assert errors(*saved) == []


@pytest.mark.parametrize("name", ["frames/a.jpg", "frames/b.jpg", "transcript.json", "evidence.html", "capture.json"])
def test_one_altered_or_lost_file_is_one_error(saved, name):
    headers, records, files = saved
    there = (F.col("video_id") == 2) & (F.col("name") == name)
    altered = files.withColumn("sha256", F.when(there, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    assert errors(headers, records, altered) == [(2, name, "hash mismatch")]
    assert errors(headers, records, files.filter(~there)) == [(2, name, "missing or unsafe")]


def test_records_and_header_stop_the_walk(saved, spark):
    headers, records, files = saved
    second = F.col("video_id") == 2
    other = records.withColumn("summary", F.when(second & (F.col("evidence_id") == "E1"), "x").otherwise(F.col("summary")))
    assert errors(headers, other, files.filter("name <> 'capture.json'")) == [(1, "capture.json", "missing or unsafe"), (2, "(records)", "hash mismatch")]
    assert errors(headers, records.filter(~second), files) == [(2, "(records)", "hash mismatch")]
    assert errors(headers, records.unionByName(records.filter("evidence_id = 'E9'")), files) == [(2, "(records)", "hash mismatch")]
    tagged = headers.withColumn("schema_tag", F.when(second, "v0").otherwise(F.col("schema_tag")))
    assert errors(tagged, records, files) == [(2, "(header)", "unsupported schema")]


def test_paths_and_missing_parts(saved, spark):
    _, records, files = saved
    unsafe = records.withColumn("frame_file", F.when(F.col("evidence_id") == "E0", "../frames/a.jpg").otherwise(F.col("frame_file")))
    reachable = files.unionByName(spark.createDataFrame([(1, "../frames/a.jpg", SHA["a"])], files.schema))
    assert errors(I.bundle_header(unsafe, files), unsafe, reachable) == [(v, "../frames/a.jpg", "missing or unsafe") for v in (1, 2)]
    bare = files.filter("name like 'frames%'")
    assert errors(I.bundle_header(records, bare), records, bare) == [(v, "transcript.json", "transcript unavailable") for v in (1, 2)]
    assert errors(I.bundle_header(records.limit(0), files), records, files) == []
