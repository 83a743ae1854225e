"""The dyadic interval index against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import align as A

SNIPPET = "video_id long, pos long, code string, start_s double, duration_s double, text string"
FRAME = "video_id long, frame_id string, seconds long, decoded_s double"


def test_nodes_cover_every_bucket_once(spark):
    rng = random.Random(7)
    ranges = [(0, 1), (-5, 9), (-1, 0), (1, 2), (0, 64), (3, 3 + (1 << 40)), *(((low := rng.randint(-300, 300)), low + rng.randint(1, 500)) for _ in range(60))]
    rows = spark.createDataFrame(ranges, "low long, high long").select("low", "high", A.dyadic_nodes(F.col("low"), F.col("high")).alias("nodes")).collect()
    for low, high, nodes in rows:
        spans = sorted((n.node << n.level, (n.node + 1) << n.level) for n in nodes)
        assert spans[0][0] == low and spans[-1][1] == high and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert len(nodes) <= 2 * (high - low).bit_length()


@pytest.mark.parametrize(("window", "bucket"), [(8, 60), (8, 4), (0.5, 3), (130, 60)])
def test_context_equals_all_pairs(spark, window, bucket):
    rng = random.Random(bucket)
    lengths = [0, 1, 2.5, 40, 300, 5000, -3, None]
    captions = [(v, i, "c", rng.choice([5.0, 5.0, rng.randint(-50, 900), rng.random() * 900]), rng.choice(lengths), f"t{i}") for v in (1, 2, None) for i in range(150)]
    captions += [(3, i, "c", 0.0, 1e6, "all") for i in range(40)] + [(1, 999, "c", None, 2.0, "x"), (1, 998, "c", 5.0, 2.0, " \n"), (1, 997, "c", 5.0, 2.0, None)]
    captions = [(v, i, c, None if s is None else float(s), None if d is None else float(d), t) for v, i, c, s, d, t in captions]
    frames = [(v, f"F{i:03d}", rng.randint(-60, 1000), rng.choice([None, rng.random() * 1000])) for v in (1, 2, 3, 4) for i in range(25)]
    got = {}
    for r in A.caption_context_join(spark.createDataFrame(frames, FRAME), spark.createDataFrame(captions, SNIPPET), window=window, bucket=bucket, nearest=6).collect():
        got.setdefault((r["video_id"], r["frame_id"]), []).append((r["rank"], round(r["distance"], 9), r["pos"]))
    for v, f, s, d in frames:
        at = d if d is not None else s
        near = sorted((max(c[3] - at, at - c[3] - max(c[4] or 0, 0), 0.0), c[1]) for c in captions if c[0] == v and c[3] is not None and (c[5] or "").strip())
        want = [(k + 1, round(dist, 9), pos) for k, (dist, pos) in enumerate([x for x in near if x[0] <= window][:6])]
        assert sorted(got.get((v, f), [])) == want


def test_a_caption_of_ten_years_makes_few_rows(spark):
    nodes = spark.range(1).select(F.size(A.dyadic_nodes(F.lit(1).cast("long"), F.lit(5_000_001).cast("long")))).first()[0]
    assert nodes < 96
    captions = spark.createDataFrame([(1, 0, "c", 30.0, 3e8, "long"), (1, 1, "c", 100.0, 1.0, "short")], SNIPPET)
    frames = spark.createDataFrame([(1, "F001", 101, None), (1, "F002", 150_000_000, None), (1, "F003", 400_000_000, None)], FRAME)
    got = sorted((r["frame_id"], r["caption"]) for r in A.caption_context_join(frames, captions).collect())
    assert got == [("F001", "long"), ("F001", "short"), ("F002", "long")]
