"""Views over the given tables that stand in for captions, frames, replies and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import numbered
from ..sources.tables import load


def plain_documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents", spread_by="doc_id").select(
        "doc_id", "source",
        F.concat(F.lit("https://example.com/doc/"), F.col("doc_id").cast("string")).alias("url"),
        "text",
    )


def documents_plus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with formula-like titles and, on some, a fee line and a link-only line."""
    n = F.col("doc_id")
    fee = F.concat(
        F.lit("\nFee $"), n.cast("string"),
        F.lit(" before the deadline 2026-10-01, see [terms](https://example.com/"),
        n.cast("string"), F.lit(")."),
    )
    title = F.element_at(
        F.array(*[F.lit(t) for t in ("=1+1", "+x", "-x", "@x", "plain")]), (n % 5 + 1).cast("int")
    )
    return load(spark, folder, "documents", spread_by="doc_id").select(
        "doc_id", "lang", "source", title.alias("title"),
        F.concat(F.lit("https://example.com/doc/"), n.cast("string")).alias("url"),
        F.concat(
            "text",
            F.when(n % 3 == 0, fee).otherwise(F.lit("")),
            F.when(n % 4 == 0, F.lit("\n[nav](https://example.com/)")).otherwise(F.lit("")),
        ).alias("text"),
    )


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    """One fetch attempt per event, ordered by event id."""
    kind, value = F.col("event_type"), F.col("value")
    status = (
        F.when(kind.isin("click", "view"), 200)
        .when(kind == "signup", 404)
        .when(kind == "purchase", 429)
        .when(value > 10, 503)
    )
    return load(spark, folder, "events").select(
        F.concat(F.lit("https://example.com/u/"), F.col("user_id").cast("string")).alias("url"),
        (F.col("user_id") % 10).alias("run_id"),
        F.col("event_id").alias("attempt"),
        status.alias("status"),
        (F.coalesce(status, F.lit(0)) == 200).alias("ok"),
        F.when(status.isNull(), "timed out").otherwise("").alias("error_text"),
    )


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows: documents with their label as outcome and summary state."""
    labels = load(spark, folder, "labels")
    docs = documents_plus(spark, folder)
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "source", "url", "title", F.col("text").alias("markdown"),
        (~toxic).alias("success"),
        F.when(toxic, "HTTP 404").otherwise("").alias("error"),
        F.lit("").alias("summary"),
        F.when(F.col("quality").isNull(), "尚未完成")
        .when(F.col("quality") == 0, "基本摘錄")
        .otherwise("openai").alias("summary_mode"),
    )


def turn_captions(spark: SparkSession, folder: str) -> DataFrame:
    """One caption per conversation turn, 17 seconds apart."""
    turn = F.col("turn")
    return load(spark, folder, "conversations", spread_by="conv_id").select(
        F.col("conv_id").alias("video_id"),
        turn.alias("pos"),
        F.lpad(F.col("conv_id").cast("string"), 11, "0").alias("code"),
        (turn * 17 + (F.col("conv_id") % 5) * 0.25).alias("start_s"),
        (turn % 3 + 4).cast("double").alias("duration_s"),
        "text",
    )


def short_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn's whole text in pieces of 30 characters, 1.5 seconds apart."""
    k = F.col("k")
    pieces = turn_captions(spark, folder).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 30).cast("int")))
    )
    return pieces.select(
        "video_id",
        (F.col("pos") * 1000000 + k).alias("pos"),
        (F.col("pos") * 17 + k * 1.5).alias("start_s"),
        "duration_s",
        F.substring("text", k * 30 + 1, F.lit(30)).alias("text"),
    ).filter(F.col("text").rlike(r"\S"))


def caption_tracks(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    return load(spark, folder, "documents").select(
        F.floor(n / 4).alias("video_id"), n.alias("pos"),
        F.col("lang").alias("language"), (n % 2 == 1).alias("generated"),
    )


def turn_frames(spark: SparkSession, folder: str) -> DataFrame:
    """One frame per conversation turn, with the text visible on it."""
    turn, conv = F.col("turn"), F.col("conv_id")
    t = turn.cast("string")
    return load(spark, folder, "conversations", spread_by="conv_id").select(
        conv.alias("video_id"),
        numbered("F", turn).alias("frame_id"),
        turn.alias("pos"),
        F.lpad(conv.cast("string"), 11, "0").alias("code"),
        (turn * 17 + 3).alias("seconds"),
        F.when(conv % 4 != 0, turn * 17 + 3.04).cast("double").alias("decoded_s"),
        F.when(conv % 3 == 0, F.col("text"))
        .when(conv % 3 == 1, F.concat(F.lit("Q"), t, F.lit(" "), (turn * 5).cast("string")))
        .otherwise(F.concat(F.lit("訂閱 活動 "), t)).alias("ocr"),
        F.when(conv % 7 == 0, None).when(conv % 2 == 0, "hardware-verified")
        .otherwise("software-fallback").alias("decoder_status"),
        F.concat(F.lit("frames/"), numbered("F", turn), F.lit(".jpg")).alias("file"),
    )


def frame_ocr_lines(frames: DataFrame) -> DataFrame:
    return frames.select("video_id", "frame_id", F.posexplode(F.split("ocr", "\n")).alias("ocr_pos", "text")).filter(
        F.col("text") != ""
    )


def frame_boxes(frames: DataFrame) -> DataFrame:
    """Two number-over-label pairs on the frames of every third video."""
    t = F.col("pos").cast("string")
    item = lambda n, text, x, y: F.struct(
        F.lit(n).alias("n"), text.alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")
    )
    items = F.array(
        item(1, (F.col("pos") * 5).cast("string"), 100, 50),
        item(2, F.concat(F.lit("Q"), t), 110, 200),
        item(3, t, 300, 50),
        item(4, F.concat(F.lit("R"), t), 310, 200),
    )
    return frames.filter(F.col("video_id") % 3 == 1).select(
        "video_id", "frame_id", F.explode(items).alias("i")
    ).select("video_id", "frame_id", "i.*")


def ocr_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Three OCR boxes (number, label, step) per order line, a frame per order."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    n, part, supp = F.col("n"), F.col("l_partkey"), F.col("l_suppkey")
    item = lambda k, text, x, y, confidence: F.struct(
        (n * 3 + k).alias("pos"), text.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"),
        confidence.cast("double").alias("confidence"),
    )
    corner = lambda dx, dy: F.struct((F.col("i.x") + dx).alias("x"), (F.col("i.y") + dy).alias("y"))
    lines = load(spark, folder, "lineitem", spread_by="l_orderkey").withColumn("n", F.row_number().over(order))
    items = F.array(
        item(0, F.col("l_quantity").cast("int").cast("string"), part % 1280, supp % 200, F.col("l_discount") * 10),
        item(1, F.concat(F.lit("Q"), n.cast("string")), part % 1280 + supp % 60 - 30, supp % 200 + 200, F.lit(0.9)),
        item(2, F.concat(F.lit("STEP"), n.cast("string")), n * 150, 650 + n * 10, F.lit(0.8)),
    )
    return lines.select(F.col("l_orderkey").alias("frame_id"), F.explode(items).alias("i")).select(
        "frame_id", F.col("i.pos").alias("pos"), F.col("i.text").alias("text"),
        F.col("i.confidence").alias("confidence"),
        F.array(corner(-10, -5), corner(10, -5), corner(10, 5), corner(-10, 5)).alias("corners"),
    )


def event_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Key-frame candidates: a video per user, its events scaled to seconds."""
    events = load(spark, folder, "events").withColumn("us", F.unix_micros("ts"))
    spans = events.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    scale = lambda c: (F.col(c) - F.col("lo")) / 1e9
    return events.join(spans, "user_id").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("pos"),
        scale("us").alias("at_s"), F.col("value").alias("score"), scale("hi").alias("duration_s"),
    )


def vector_features(spark: SparkSession, folder: str) -> DataFrame:
    """Frame features: a series of 48 frames, as many as one video offers, per vector id range."""
    return load(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 48).alias("series"), F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vector"), (F.col("label") * 10.0).alias("edge"),
    )


def envelope_replies(spark: SparkSession, folder: str) -> DataFrame:
    """One raw model reply per document, in the envelope of one of three providers."""
    n = F.col("doc_id")
    bad = n % 11 == 0
    refs = F.when(n % 13 == 0, "[]").when(n % 5 == 0, '["S001","S999"]').otherwise('["S001"]')
    item = F.concat(F.lit('{"text":"Claim about document '), n.cast("string"), F.lit('","sources":'), refs, F.lit("}"))
    answer = F.concat(
        F.lit('{"overview":'), item, F.lit(',"points":['), item, F.lit('],"facts":[],"uncertainties":"none"}')
    )
    half = F.floor(F.length("answer") / 2).cast("int")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    ollama = F.concat(
        F.lit('{"done_reason":"'), F.when(bad, "length").otherwise("stop"),
        F.lit('","message":{"role":"assistant","content":'), quoted(F.col("answer")), F.lit("}}"),
    )
    openai = F.concat(
        F.lit('{"choices":[{"finish_reason":"'), F.when(bad, "content_filter").otherwise("stop"),
        F.lit('","message":{"content":'), quoted(F.col("answer")), F.lit(',"refusal":null}}]}'),
    )
    gemini = F.concat(
        F.lit('{"candidates":[{"finishReason":"'), F.when(bad, "MAX_TOKENS").otherwise("STOP"),
        F.lit('","content":{"parts":[{"text":"thinking","thought":true},{"text":'),
        quoted(F.substring(F.col("answer"), F.lit(1), half)), F.lit('},{"text":'),
        quoted(F.substring(F.col("answer"), half + 1, F.length("answer"))), F.lit("}]}}]}"),
    )
    provider = F.element_at(F.array(F.lit("ollama"), F.lit("openai"), F.lit("gemini")), (n % 3 + 1).cast("int"))
    return (
        load(spark, folder, "documents").select("doc_id", provider.alias("provider"), answer.alias("answer"))
        .withColumn("raw", F.when(n % 3 == 0, ollama).when(n % 3 == 1, openai).otherwise(gemini))
        .drop("answer")
    )


def _summary_json(text, refs):
    item = F.concat(F.lit('{"text":"'), text, F.lit('","sources":["'), F.array_join(refs, '","'), F.lit('"]}'))
    return F.concat(F.lit('{"overview":'), item, F.lit(',"points":['), item, F.lit('],"facts":[],"uncertainties":"無"}'))


def chunk_replies(chunks: DataFrame) -> DataFrame:
    """One reply per chunk that cites its first unit; some cite an unknown one, some are missing."""
    n = F.col("doc_id") * 3 + F.col("chunk_no")
    refs = F.array(F.when(n % 13 == 0, "S99999").otherwise(F.col("first_unit")))
    text = F.format_string("Part %d has %d units", "chunk_no", "n_units")
    return chunks.filter(n % 17 != 0).select("doc_id", "chunk_no", _summary_json(text, refs).alias("answer"))


def merge_replies(chunks: DataFrame) -> DataFrame:
    """One reply over all parts of a document of several; some are missing or cite a unit that
    no part does."""
    ends = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("first_unit", "chunk_no").alias("a"), F.max_by("first_unit", "chunk_no").alias("b"))
    refs = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("S002"))).otherwise(F.array("a", "b"))
    return ends.filter("n > 1 and doc_id % 5 <> 0").select(
        "doc_id", _summary_json(F.format_string("Whole of %d parts", "n"), refs).alias("answer"))


def comparison_answers(units: DataFrame) -> DataFrame:
    """One comparison answer per excerpt; even documents cite a neighbour, odd ones only
    themselves, and some break the other rules."""
    own = F.col("unit_id")
    n = F.col("document")
    other = F.format_string("S%03d", n - 1)
    refs = (
        F.when(n % 5 == 0, F.array(F.lit("S99999")))
        .when(n % 2 == 0, F.array(own, other))
        .otherwise(F.array(own, own))
    )
    text = F.when(F.col("doc_id") % 17 == 0, "short").otherwise(
        F.concat(F.lit("Both sources state point "), n.cast("string"))
    )
    claim = lambda t, r: F.struct(t.alias("text"), r.alias("sources"))
    single = claim(F.concat(F.lit("Only source "), n.cast("string"), F.lit(" says so")), F.array(own))
    answer = F.to_json(F.struct(
        F.array(claim(text, refs)).alias("common"),
        F.array().cast("array<struct<text:string,sources:array<string>>>").alias("differences"),
        F.array_repeat(single, F.when(F.col("doc_id") % 19 == 0, 6).otherwise(2)).alias("unique"),
    ))
    return units.select(F.col("doc_id").alias("answer_id"), "source", answer.alias("answer"))


def note_replies(chunks: DataFrame) -> DataFrame:
    """One reply per caption chunk with a note per block, some of them breaking a rule."""
    video = F.col("video_id")

    def note(u, i):
        following = F.get(F.col("units"), i + 1)["text"]
        no = u["unit_no"]
        return F.struct(
            F.when(no % 6 == 5, "T").otherwise(F.concat(F.lit("Turn "), no.cast("string"))).alias("title"),
            F.when(no % 7 == 3, "影片主要介紹各種技巧").otherwise(
                F.concat(F.lit("The speaker states: "), u["text"])).alias("text"),
            F.when(video % 3 == 0, "not in the source at all")
            .when((no % 3 == 1) & following.isNotNull(), F.concat(u["text"], F.lit(" "), following))
            .otherwise(u["text"]).alias("evidence"),
            F.array(F.when(no % 4 == 0, "S999").otherwise(u["unit_id"])).alias("sources"),
        )

    unsure = F.when(video % 2 == 0, F.concat(F.lit("unclear in part "), (F.col("chunk_no") % 2).cast("string"))).otherwise("無")
    return chunks.select(
        "video_id", "chunk_no",
        F.to_json(F.struct(F.transform("units", note).alias("notes"), unsure.alias("uncertainties"))).alias("answer"),
    )


def note_verdicts(points: DataFrame) -> DataFrame:
    """A verdict for every kept point but some."""
    total = F.col("video_id") + F.col("chunk_no")
    return points.filter(~((total % 11 == 0) & (F.col("n") == 2))).select(
        "video_id", "chunk_no", "n", ((total + F.col("n")) % 5 != 0).alias("supported")
    )


def markdown_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One Markdown report per document with every kind of block."""
    n = F.col("doc_id").cast("string")
    lines = F.array(
        F.concat(F.lit("# Report "), n), F.lit(""), F.lit("## Findings"), F.lit(""),
        F.concat(F.lit("- item "), F.col("lang")), F.lit(""), F.concat(F.lit("> "), F.col("source")), F.lit(""),
        F.concat(F.lit("![frame](frames/"), n, F.lit(".jpg)")), F.lit(""), F.lit("### Table"), F.lit(""),
        F.lit("|k|v|"), F.lit("|---|---|"), F.concat(F.lit("|lang|"), F.col("lang"), F.lit("|")), F.lit(""),
        F.concat(F.lit("[link](https://example.com/"), n, F.lit(") tail")), F.lit(""), F.lit("### Text"), F.lit(""),
        F.col("text"),
    )
    return load(spark, folder, "documents", spread_by="doc_id").select("doc_id", F.array_join(lines, "\n").alias("text"))
