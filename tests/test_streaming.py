import os

import pandas as pd
from pyspark.sql import functions as F

from attestry.operators.segment import source_units
from attestry.plans import streams
from attestry.sources.pages import page_extract
from attestry.streaming import blocks, ingest, progress

PAGE = "page_id long, url string, html string"


def test_repeated_pages_are_stored_once(spark, tmp_path):
    page = lambda i, url: (i, url, f"<title>t{i}</title><p>Body of page number {i} here.</p>")
    source, target = tmp_path / "in", str(tmp_path / "out")
    first = spark.createDataFrame([page(1, "https://e.com"), page(2, "https://e.com/b"), page(3, "ftp://x")], PAGE)
    first.coalesce(1).write.parquet(str(source / "day=1"))
    run = lambda: ingest.stream_page_ingest(
        ingest.page_stream(spark, f"{source}/day=*", first.schema, files_per_trigger=1), target).awaitTermination()
    run()
    spark.createDataFrame([page(4, "https://e.com/#again"), page(5, "https://e.com/c")], PAGE).coalesce(1).write.parquet(str(source / "day=2"))
    run()
    raw = spark.read.parquet(f"{target}/raw")
    assert sorted((r["page_id"], r["canonical"]) for r in raw.collect()) == [
        (1, "https://e.com/"), (2, "https://e.com/b"), (5, "https://e.com/c")]
    units = spark.read.parquet(f"{target}/units")
    assert {r["page_id"] for r in units.select("page_id").distinct().collect()} == {1, 2, 5}
    texts = page_extract(raw).filter("success").select("page_id", F.col("canonical").alias("url"), "text")
    want = source_units(texts)
    got = units.select(want.columns)
    assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_progress_stream_equals_batch(spark, sf, tmp_path):
    from attestry.plans.streams import _run_events
    from attestry.sources.tables import load

    events = _run_events(load(spark, sf, "events")).repartitionByRange(5, "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress.stream_run_progress(stream, str(tmp_path / "out"), lateness="60 days").awaitTermination()
    got = progress.latest_progress(spark, str(tmp_path / "out"))
    want = progress.run_progress(events)
    cols = want.columns
    assert got.select(cols).exceptAll(want).count() == 0 and want.exceptAll(got.select(cols)).count() == 0


def greedy(rows, span, chars):
    """Brute force over (ms, pos, text) of one video."""
    out = []
    for at, _, text in sorted(rows):
        if out and at - out[-1][0] < span * 1000 and len(out[-1][2]) + len(text) <= chars:
            out[-1] = (out[-1][0], out[-1][1] + 1, out[-1][2] + " " + text)
        else:
            out.append((at, 1, text))
    return set(out)


def test_blocks_equal_brute_force_on_shuffled_arrival(spark, tmp_path):
    base = 1_700_000_000
    rows = [(v, base + i * 9 + v, i, f"caption {i} of video {v} " + "x" * (i % 5 * 40)) for v in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "video_id long, s long, pos long, text string").select(
        "video_id", F.timestamp_seconds("s").alias("ts"), "pos", "text")
    late = (F.unix_seconds("ts") - base) / 90 + F.col("pos") % 3 / 3
    for part in range(5):
        piece = df.filter(F.floor(late) == part) if part < 4 else df.filter(F.floor(late) >= 4)
        piece.coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    closing = spark.createDataFrame([(-1, base + 10_000_000, 0, "")], "video_id long, s long, pos long, text string").select(
        "video_id", F.timestamp_seconds("s").alias("ts"), "pos", "text")
    closing.coalesce(1).write.parquet(str(tmp_path / "in/part=9"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    blocks.stream_caption_blocks(stream, str(tmp_path / "out"), span=35, chars=200, lateness="10 minutes").awaitTermination()
    got = spark.read.schema(blocks.OUTPUT).parquet(str(tmp_path / "out/blocks")).filter("video_id >= 0").collect()
    for v in range(3):
        mine = {(r["start_ms"], r["n_captions"], r["text"]) for r in got if r["video_id"] == v}
        assert mine == greedy([(s * 1000, p, t) for w, s, p, t in rows if w == v], 35, 200)


def test_the_earliest_copy_is_stored_and_never_replaced(spark, tmp_path):
    """Copies in one batch: the smallest id. Copies long after: the stored one stays."""
    page = lambda i, url: (i, url, f"<title>t{i}</title><p>Body of page number {i} here.</p>")
    target = str(tmp_path / "out")
    for day, ids in enumerate(([9, 4, 7], [1, 12])):
        rows = [page(i, "https://e.com/a") for i in ids] + [page(20 + day, f"https://e.com/{day}")]
        rows += rows[:1]
        spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"day={day}"))
        schema = spark.createDataFrame([], PAGE).schema
        ingest.stream_page_ingest(ingest.page_stream(spark, f"{tmp_path}/in/day=*", schema), target).awaitTermination()
    raw = spark.read.parquet(f"{target}/raw")
    assert sorted((r["page_id"], r["canonical"]) for r in raw.collect()) == [
        (4, "https://e.com/a"), (20, "https://e.com/0"), (21, "https://e.com/1")]


def test_late_captions_are_counted(spark, tmp_path):
    base = 1_700_000_000
    days = [[(1, base, 1, "first"), (1, base + 5000, 2, "second")], [(1, base + 9000, 3, "third")], [(1, base + 1, 4, "late")],
            [(1, base + 90_000, 5, "closing")]]
    for day, rows in enumerate(days):
        spark.createDataFrame(rows, "video_id long, s long, pos long, text string").select(
            "video_id", F.timestamp_seconds("s").alias("ts"), "pos", "text").coalesce(1).write.parquet(str(tmp_path / f"in/day={day}"))
    stream = spark.readStream.schema("video_id long, ts timestamp, pos long, text string").option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in/day=*"))
    query = blocks.stream_caption_blocks(stream, str(tmp_path / "out"), lateness="10 minutes")
    query.awaitTermination()
    assert blocks.late_captions(query) == 1
    assert "late" not in {r["text"] for r in spark.read.schema(blocks.OUTPUT).parquet(str(tmp_path / "out/blocks")).collect()}


def test_caption_query_loses_nothing_over_many_files(spark, tmp_path):
    """Thirty files, the newest written first, eight a trigger: no caption falls behind the watermark."""
    base = 1_700_000_000
    rows = [(k, base + k * 20_000, k % 3, f"caption {k}") for k in range(600)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, props string").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "props")
    part = 29 - F.floor(F.col("event_id") / 20)
    for k in range(30):
        events.filter(part == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = streams.stream_caption_blocks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    for v in range(3):
        mine = {(r["start_ms"], r["n_captions"], r["text"]) for r in got if r["video_id"] == v}
        assert mine == greedy([(s * 1000, p, t) for p, s, w, t in rows if w == v], streams.BLOCK_SPAN, 1000)


def test_a_replayed_batch_stores_the_same_pages(spark, tmp_path):
    """The last batch is run again from the state before it, as after a failure."""
    page = lambda i, url: (i, url, f"<title>t{i}</title><p>Body of page number {i} here.</p>")
    target = str(tmp_path / "out")
    schema = spark.createDataFrame([], PAGE).schema
    run = lambda: ingest.stream_page_ingest(ingest.page_stream(spark, f"{tmp_path}/in/day=*", schema), target).awaitTermination()
    for day, rows in enumerate([[page(1, "https://e.com/a")], [page(2, "https://e.com/a"), page(3, "https://e.com/b"), page(None, "https://e.com/c")]]):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"day={day}"))
        run()
    stored = lambda: sorted((r["canonical"], r["page_id"] or 0) for r in spark.read.parquet(f"{target}/raw").collect())
    before = stored()
    assert before == [("https://e.com/a", 1), ("https://e.com/b", 3), ("https://e.com/c", 0)]
    commits = sorted(p for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit())
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (commits[-1].parent / name).unlink(missing_ok=True)
    run()
    assert stored() == before


def test_late_captions_of_all_batches_are_counted(spark, tmp_path):
    """More batches than the query keeps reports of."""
    listener = blocks.LateCaptions()
    spark.streams.addListener(listener)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        base = 1_700_000_000
        for day in range(8):
            rows = [(1, base + day * 9000, day, "on time"), (1, base + 1, 100 + day, "late")]
            spark.createDataFrame(rows, "video_id long, s long, pos long, text string").select(
                "video_id", F.timestamp_seconds("s").alias("ts"), "pos", "text").coalesce(1).write.parquet(str(tmp_path / f"in/day={day}"))
        stream = spark.readStream.schema("video_id long, ts timestamp, pos long, text string").option("maxFilesPerTrigger", 1).parquet(
            str(tmp_path / "in/day=*"))
        query = blocks.stream_caption_blocks(stream, str(tmp_path / "out"), lateness="10 minutes")
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        late = listener.count(query)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    blocks_there = spark.read.schema(blocks.OUTPUT).parquet(str(tmp_path / "out/blocks")).collect()
    shown = sum(r["text"].count("late") for r in blocks_there)
    # Each file's late caption is dropped, or shown if it came before the watermark moved.
    assert late > blocks.late_captions(query) and late + shown in (7, 8)


def test_tables_of_many_files_are_streamed_whole(spark, tmp_path):
    """Tables that are folders; the pages' smaller ids lie in the newer file."""
    page = lambda i, url: (i, url, f"<title>t{i}</title><p>Body of page number {i} here.</p>")
    for part, rows in enumerate([[page(7, "https://e.com/a"), page(8, "https://e.com/b")], [page(1, "https://e.com/a"), page(2, "https://e.com/c")]]):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages.parquet"))
        for file in (tmp_path / "pages.parquet").glob("part-*"):
            if part == 0:
                os.utime(file, (1_600_000_000, 1_600_000_000))
    events = spark.createDataFrame([(k, k * 60, k % 2, "error" if k % 3 == 0 else "view") for k in range(12)],
                                   "event_id long, s long, user_id long, event_type string").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    assert sorted(r["canonical"] for r in streams.stream_page_ingest(spark, folder).collect()) == [f"https://e.com/{x}" for x in "abc"]
    assert {r["page_id"] for r in streams.stream_page_units(spark, folder).collect()} == {1, 2, 8}
    assert sum(r["events"] for r in streams.stream_run_progress(spark, folder).collect()) == 12


def test_a_caption_costs_few_state_calls():
    """A month of captions of one video, all waiting until the watermark passes them at once."""
    calls, timers = [], set()

    class State(dict):
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("get", "getValue"):
                    return dict.get(self, args[0] if args else ())
                if name in ("exists", "containsKey"):
                    return dict.__contains__(self, args[0] if args else ())
                if name in ("update", "updateValue"):
                    self[args[0] if len(args) > 1 else ()] = args[-1]
                elif name in ("clear", "removeKey"):
                    dict.pop(self, args[0] if args else (), None)
            return call

    class Value(State):
        get = update = clear = property(lambda self: None)

        def __getattribute__(self, name):
            return State.__getattr__(self, name) if name in ("get", "update", "clear") else super().__getattribute__(name)

    class Map(State):
        def keys(self):
            calls.append("keys")
            return list(dict.keys(self))

    class Handle:
        getValueState = staticmethod(lambda *a: Value())
        getMapState = staticmethod(lambda *a: Map())
        registerTimer = staticmethod(lambda at: (calls.append("timer"), timers.add(at)))

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**14)

    base, hour, span = 1_700_000_000_000, 3_600_000, 12 * 3600
    rows = [(base + k * 7 * hour, k, f"caption {k}") for k in range(100)]
    processor = blocks.BlockProcessor(span * 1000, 1000, 90 * hour)
    processor.init(Handle)
    list(processor.handleInputRows((1,), iter([pd.DataFrame(rows[::-1], columns=["at_ms", "pos", "text"])]), Times))
    got = [frame for at in sorted(timers) for frame in processor.handleExpiredTimer((1,), Times, at)]
    assert {tuple(r)[1:] for r in pd.concat(got).itertuples(index=False)} == greedy(rows, span, 1000)
    assert len(calls) < len(rows)


def test_videos_share_the_state_of_their_shard():
    """Sixty videos under one key; captions arrive in two parts and the watermark moves on in steps."""
    calls, timers, now = [], set(), [0]

    class Value:
        value = None
        get = lambda self: (calls.append("get"), self.value)[1]
        update = lambda self, value: (calls.append("update"), setattr(self, "value", value))
        clear = lambda self: (calls.append("clear"), setattr(self, "value", None))

    class Map(dict):
        keys = lambda self: (calls.append("keys"), list(dict.keys(self)))[1]
        getValue = lambda self, key: (calls.append("getValue"), self[key])[1]
        updateValue = lambda self, key, value: (calls.append("updateValue"), self.update({key: value}))
        removeKey = lambda self, key: (calls.append("removeKey"), self.pop(key))

    class Handle:
        getValueState = staticmethod(lambda *a: Value())
        getMapState = staticmethod(lambda *a: Map())
        registerTimer = staticmethod(lambda at: (calls.append("timer"), timers.add(at)))

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: now[0])

    span, bucket = 35, 100_000
    rows = [(v, -150_000 + k * 9_000 + v, k, f"caption {k} of {v} " + "x" * (k % 5 * 40)) for v in range(60) for k in range(40)]
    processor = blocks.BlockProcessor(span * 1000, 200, bucket)
    processor.init(Handle)
    got = []
    for begin in range(2):
        frames = [pd.DataFrame(rows[begin + 2 * k : begin + 2 * k + 800 : 2], columns=["video_id", "at_ms", "pos", "text"]) for k in (800, 0, 400)]
        list(processor.handleInputRows((7,), iter(frames), Times))
    for now[0] in range(-150_000, 500_000, 70_000):
        while due := [at for at in timers if at <= now[0]]:
            for at in sorted(due):
                got += processor.handleExpiredTimer((7,), Times, at)
                timers.discard(at)
        latest = max((start for frame in got for start in frame["start_ms"]), default=now[0])
        assert latest <= now[0]
    got = list(pd.concat(got).itertuples(index=False, name=None))
    for v in range(60):
        assert {r[1:] for r in got if r[0] == v} == greedy([r[1:] for r in rows if r[0] == v], span, 200)
    assert len(got) == len(set(got)) and len(calls) < len(rows) / 10


def test_a_stream_of_many_videos_keeps_few_keys(spark, tmp_path):
    base = 1_700_000_000
    rows = [(v, base + i * 20 + v % 7, i, f"caption {i} of video {v}") for v in range(300) for i in range(4)]
    df = spark.createDataFrame(rows, "video_id long, s long, pos long, text string").select(
        "video_id", F.timestamp_seconds("s").alias("ts"), "pos", "text")
    for part in range(2):
        df.filter(F.col("pos") % 2 == part).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    spark.createDataFrame([(-1, base + 10_000_000, 0, "")], "video_id long, s long, pos long, text string").select(
        "video_id", F.timestamp_seconds("s").alias("ts"), "pos", "text").coalesce(1).write.parquet(str(tmp_path / "in/part=9"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    query = blocks.stream_caption_blocks(stream, str(tmp_path / "out"), shards=4)
    query.awaitTermination()
    got = spark.read.schema(blocks.OUTPUT).parquet(str(tmp_path / "out/blocks")).filter("video_id >= 0").collect()
    for v in range(300):
        mine = {(r["start_ms"], r["n_captions"], r["text"]) for r in got if r["video_id"] == v}
        assert mine == greedy([(s * 1000, p, t) for w, s, p, t in rows if w == v], 35, 1000)
    assert max(state.numRowsTotal for report in query.recentProgress for state in report.stateOperators) < 300
