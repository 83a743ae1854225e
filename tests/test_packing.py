"""Packing of rows against a walk over the items, with stretches short and long."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attestry.operators import captions as K
from attestry.operators.packing import packed

ITEM = "video long, part string, n long, words string, at double"


def walk(items, max_size, max_span, joiner):
    """Pack number of each (size, at), one after another."""
    out, pack, held, start = [], 0, 0, 0.0
    for k, (size, at) in enumerate(items):
        late = max_span is not None and at is not None and start is not None and at - start >= max_span
        if k == 0 or held + size > max_size or late:
            pack, held, start = pack + 1, size, at
        else:
            held += size + joiner
        out.append(pack)
    return out


@pytest.mark.parametrize(("width", "max_size", "max_span", "joiner"), [
    (20, 12, 9, 1), (20, 12, None, 0), (64, 40, 9, 1), (1 << 16, 12, 9, 0), (50, 5, 3, 0)])
def test_packs_equal_the_walk(spark, width, max_size, max_span, joiner):
    rng = random.Random(width + max_size)
    rows, expected = [], {}
    for key, (video, part, count) in enumerate([(1, "a", 1), (1, "b", 20), (2, "a", 400), (None, "a", 130), (3, None, 61), (4, "a", 40), (5, "x", 2500)]):
        at, items = 0.0, []
        for n in range(count):
            at += rng.choice([0, 0, 1, 2, 5, -3, 20])
            items.append((rng.choice([1, 1, 2, 3, 7, 15]), rng.choice([at, at, at, at, at, None])))
        expected |= {(video, part, n + 1): p for n, p in enumerate(walk(items, max_size, max_span, joiner))}
        rows += [(video, part, n + 1, "w" * size, at) for n, (size, at) in enumerate(items)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, ITEM).repartition(5)
    got = packed(frame, ["video", "part"], "n", F.length("words"), at=F.col("at"), max_size=max_size, max_span=max_span, joiner=joiner, width=width)
    assert got.columns == [*frame.columns, "pack"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.video, r.part, r.n].append(r.pack)
    assert found == {k: [p] for k, p in expected.items()}


def test_one_video_of_a_million_captions(spark):
    n = 1_000_000
    times = F.col("n") * 3 + F.pmod(F.hash("n"), F.lit(7))
    words = F.repeat(F.lit("x"), (F.pmod(F.xxhash64("n"), F.lit(90)) + 5).cast("int"))
    rows = spark.range(1, n + 1, 1, 8).withColumnRenamed("id", "n").select(F.lit(1).cast("long").alias("video"), "n", words.alias("words"), times.alias("at"))
    got = packed(rows, ["video"], "n", F.length("words"), at=F.col("at"), max_size=1000, max_span=35, joiner=1).select("n", "pack", F.spark_partition_id().alias("task"))
    table = got.orderBy("n").toPandas()
    source = rows.select("n", F.length("words").alias("s"), "at").orderBy("n").toPandas()
    assert table["pack"].tolist() == walk(zip(source["s"].tolist(), source["at"].tolist()), 1000, 35, 1)
    assert table["task"].nunique() > 1


def test_nothing_and_items_without_size(spark):
    empty = spark.createDataFrame([], ITEM)
    assert packed(empty, ["video"], "n", F.length("words"), max_size=5).count() == 0
    blank = spark.createDataFrame([(1, "a", 1, "", 0.0)], ITEM)
    with pytest.raises(Exception, match="size of one at least"):
        packed(blank, ["video"], "n", F.length("words"), max_size=5).collect()
    with pytest.raises(ValueError):
        packed(blank, ["video"], "n", F.length("words"), max_size=5, width=6)


def lines(spark, n, step, body="Claim number %d shows a change with an explanation."):
    link = "https://www.youtube.com/watch?v=abcdefghijk&t=%ds"
    rows = [(1, i, f"[{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}]({link % s}) {body % i}") for i, s in enumerate(range(0, n * step, step))]
    return spark.createDataFrame(rows, "video_id long, pos long, line string")


def test_blocks_measure_time_from_their_own_start(spark):
    units = K.caption_blocks(lines(spark, 10, 20)).orderBy("unit_no").collect()
    assert [u["seconds"] for u in units] == [0, 40, 80, 120, 160]
    assert all(u["n_captions"] == 2 for u in units)
    assert units[1]["text"] == "Claim number 2 shows a change with an explanation. Claim number 3 shows a change with an explanation."


def test_videos_without_captions_have_source_units(spark):
    noise = "[00:00:01](https://www.youtube.com/watch?v=abcdefghijk&t=1s) [Music]"
    rows = [(2, 0, noise), (2, 1, "Plain sentence here."), (3, 0, noise), (3, 1, noise.replace("[Music]", "Spoken words."))]
    both = lines(spark, 1, 1).unionByName(spark.createDataFrame(rows, "video_id long, pos long, line string"))
    got = {v: [u for u in K.caption_blocks(both).orderBy("unit_no").collect() if u["video_id"] == v] for v in (1, 2, 3)}
    assert [len(x) for x in got.values()] == [1, 2, 1]
    assert got[2][1]["text"] == "Plain sentence here." and got[2][0]["time"] is None and got[2][0]["n_captions"] == 0
    assert got[3][0]["text"] == "Spoken words."


def test_sample_covers_the_end(spark):
    cut = K.timeline_sample(K.caption_blocks(lines(spark, 120, 40)), budget=3000).orderBy("unit_no").collect()
    assert all(u["sampled"] for u in cut) and cut[-1]["seconds"] == 119 * 40
    assert sum(len(u["text"]) for u in cut) <= 3000
    whole = K.timeline_sample(K.caption_blocks(lines(spark, 3, 40)), budget=3000).collect()
    assert len(whole) == 3 and not any(u["sampled"] for u in whole)
    assert K.timeline_sample(K.caption_blocks(lines(spark, 3, 40)), budget=10).count() == 0


def test_chunks_by_time_and_size(spark):
    chunks = K.chunk_units(K.caption_chunks(K.caption_blocks(lines(spark, 12, 40)))).orderBy("chunk_no").collect()
    assert [len(c["units"]) for c in chunks] == [3, 3, 3, 3]


def test_closing_promotion_is_left_out(spark):
    spoken = lines(spark, 2, 40).unionByName(lines(spark, 3, 40, "Please subscribe %d and like and share").filter("pos = 2"))
    blocks = K.caption_blocks(spoken)
    assert [(r.unit_no, r.promo) for r in K.closing_promos(blocks).collect()] == [(3, True)]
    assert K.closing_promo_trim(blocks).count() == 2
