"""Inputs beyond any guard limit, and the cases that used to fail."""

import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from attestry.functions.normalize import common_text
from attestry.functions.text import numbered
from attestry.operators import align as A
from attestry.operators import compare as C
from attestry.operators import evidence as E
from attestry.operators import frames as Fr
from attestry.operators import layout as L
from attestry.operators import reports as R
from attestry.operators.captions import transcript_text
from attestry.operators.segment import source_units
from attestry.streaming import progress


def test_a_long_document_is_cut_to_its_last_sentence(spark):
    text = "Plain words stand here. " * 26_000 + "The very last sentence."
    assert len(text) > 600_000
    units = source_units(spark.createDataFrame([(1, text, "u")], "doc_id long, text string, url string"))
    assert units.orderBy(F.desc("unit_no")).first()["text"] == "The very last sentence."


def test_reports_keep_all_sections_and_images(spark):
    text = "\n".join(f"## Part {k}\n\nbody {k}\n\n![i](img/{k}.png)\n" for k in range(60))
    report = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert R.report_sections(report).count() == 60
    assert R.report_links(report).filter("kind = 'image'").count() == 60
    assert R.report_links(report, most_images=5).filter("kind = 'image'").count() == 5


def test_all_ocr_items_are_kept(spark):
    corners = [Row(x=float(x), y=1.0) for x in range(4)]
    boxes = spark.createDataFrame([(1, k, f"t{k}", 0.9, corners) for k in range(80)],
                                  "frame_id long, pos int, text string, confidence double, corners array<struct<x:double,y:double>>")
    assert L.ocr_normalize(boxes, ["frame_id"]).count() == 80
    assert L.ocr_normalize(boxes, ["frame_id"], most=30).count() == 30


def test_common_text_of_long_texts():
    shared = "".join(chr(97 + k * k % 23) for k in range(700))
    assert common_text("x" * 3000 + shared, "y" * 5000 + shared + "z") == shared


def test_a_zero_span_video_is_selected_without_dividing(spark):
    rows = [(1, 0, 0.0, 0.5, 0.0), (2, 0, 1.0, 0.1, 10.0), (2, 1, 9.0, 0.2, 10.0)]
    frames = spark.createDataFrame(rows, "video_id long, pos long, at_s double, score double, duration_s double")
    assert {r["video_id"] for r in Fr.keyframe_select(frames).collect()} == {1, 2}


def test_blank_captions_do_not_push_out_a_real_one(spark):
    frames = spark.createDataFrame([(1, "F001", 10.0, 10)], "video_id long, frame_id string, decoded_s double, seconds int")
    rows = [(1, k, 10.0 + k / 100, 0.0, "  \n ") for k in range(10)] + [(1, 99, 12.0, 0.0, " real\nline ")]
    captions = spark.createDataFrame(rows, "video_id long, pos long, start_s double, duration_s double, text string")
    assert [(r["rank"], r["caption"]) for r in A.caption_context_join(frames, captions).collect()] == [(1, "real line")]


def test_one_source_groups_report_nothing(spark):
    text = "Some plain sentence about a price of 10 % here. " * 5
    rows = [(1, "a", text, "u1", "t", True), (2, "a", text, "u2", "t", False), (3, "b", text, "u3", "t", True), (4, "b", text, "u4", "t", True), (5, "b", text, "u5", "t", False)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, markdown string, url string, title string, success boolean")
    got = C.cross_source_summary(docs).collect()
    assert {r["source"] for r in got} == {"b"} and [r["line"] for r in got if r["section"] == "failed"] == ["u5"]


def test_hourly_windows_stay_apart(spark):
    rows = [(1, f"2024-01-01 0{h}:10:00", h, "s", True) for h in range(5)]
    events = spark.createDataFrame(rows, "run_id long, ts string, event_id long, state string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert progress.run_progress(events, window="1 hour").select("run_id", "began").distinct().count() == 5


def test_ids_grow_past_three_digits(spark):
    assert [r[0] for r in spark.range(999, 1001).select(numbered("F", F.col("id"))).collect()] == ["F999", "F1000"]


def test_nearest_match_is_linear(spark):
    def run(n):
        points = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3600 / n).alias("start_s"), F.col("id").alias("pos"), F.lit(1.0).alias("duration_s")).cache()
        asked = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3600 / n + 0.001).alias("at")).cache()
        points.count(), asked.count()
        began = time.perf_counter()
        out = E.nearest_by_time(asked, points, ["k"], at="at", start="start_s", pos="pos")
        assert out.filter("_near is null").count() == 0
        return time.perf_counter() - began

    run(1_000)
    assert run(40_000) < 10


def test_folds_stay_near_linear(spark):
    from attestry.functions.fold import pack_starts

    def run(n):
        items = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("x"))
        cuts = pack_starts(F.col("x"), lambda _: F.lit(5), lambda _: F.lit(0), 9, None)
        began = time.perf_counter()
        assert items.select(F.size(cuts)).first()[0] == n
        return time.perf_counter() - began

    run(100)
    assert run(80_000) < 8


def test_a_text_is_cut_into_tokens_once_however_many_it_has(spark):
    from attestry.operators.extract import unit_scores

    def run(n):
        words = ["".join(chr(97 + k // 26**place % 26) for place in range(4)) for k in range(n)]
        rows = [(1, 1, " ".join(words)), (1, 2, f"{words[0]} {words[0]} 5"), (1, 3, None)]
        units = spark.createDataFrame(rows, "video_id long, unit_no int, text string")
        began = time.perf_counter()
        scores = {r["unit_no"]: r["score"] for r in unit_scores(units, "video_id", "unit_no").collect()}
        assert scores == {1: (n + 1) / n, 2: 2 / 2 + 1, 3: 0}
        return time.perf_counter() - began

    run(10)
    assert run(12_000) < 8


def test_video_ids_are_percent_decoded(spark):
    from attestry.operators.urls import source_route

    urls = spark.createDataFrame([("https://www.youtube.com/watch?v=abc%44efghijk",), ("https://www.youtube.com/watch?v=%ZZ",)], "url string")
    got = {r["url"][-4:]: (r["source_type"], r["video_id"]) for r in source_route(urls).collect()}
    assert got == {"hijk": ("youtube", "abcDefghijk"), "=%ZZ": ("rejected", None)}


def test_only_the_first_title_counts(spark):
    from attestry.sources.pages import page_extract

    pages = spark.createDataFrame([(1, "u", "<title>One</title><p>x</p><svg><title>Two</title></svg>")], "page_id long, url string, html string")
    assert page_extract(pages).first()["title"] == "One"


def test_notes_of_unknown_frames_are_kept(spark):
    notes = spark.createDataFrame(
        [(1, p, f, "t", "seen", "words", 1.0, "o", "s", "temporal-only") for p, f in ((1, "F001"), (2, "F404"))],
        "video_id long, pos long, frame_id string, title string, visual_evidence string, caption string, "
        "caption_s double, ocr string, shared string, association string")
    frames = spark.createDataFrame([(1, "F001", 3, 3.0, "ok", "ab")],
                                   "video_id long, frame_id string, seconds int, decoded_s double, decoder_status string, sha256 string")
    snippets = spark.createDataFrame([(1, 0, 1.5, 2.0, "words")],
                                     "video_id long, pos long, start_s double, duration_s double, text string")
    got = {r["frame_id"]: r for r in E.evidence_records(notes, frames, snippets).collect()}
    assert (got["F001"]["decoder_status"], got["F001"]["frame_sha256"], got["F001"]["model"]) == ("ok", "ab", None)
    assert got["F404"]["decoder_status"] == "no such frame" and got["F404"]["caption_start"] == 1.5


def test_long_transcripts_are_whole_unless_limited(spark):
    lines = spark.range(3000).select(F.lit(1).alias("video_id"), F.col("id").alias("pos"), F.lit("w" * 200).alias("line"))
    whole, part = transcript_text(lines).first(), transcript_text(lines, max_chars=1000).first()
    assert len(whole["text"]) == 3000 * 202 - 2 and not whole["truncated"]
    assert len(part["text"]) == 1000 and part["truncated"]


def test_ocr_rows_are_numbered_without_their_corners(spark):
    """What the window sorts and holds per box is what comes out of it."""
    boxes = spark.createDataFrame(
        [(1, 2, " b ", 0.9, [(0.0, 0.0), (4.0, 2.0)]), (1, 1, "a", 0.9, [(0.0, 0.0), (2.0, 6.0)])],
        "frame_id long, pos long, text string, confidence double, corners array<struct<x:double,y:double>>")
    items = L.ocr_normalize(boxes, ["frame_id"])
    assert [tuple(r) for r in items.orderBy("n").collect()] == [(1, 1, 1, "a", 0.9, 1.0, 3.0), (1, 2, 2, "b", 0.9, 2.0, 1.0)]
    node = items._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    assert "corners" not in node.children().head().output().mkString(" ")
