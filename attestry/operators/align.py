"""Frames against captions: interval joins, shared text, promotion and novelty rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.normalize import longest_common_text, normalize, similarity
from ..functions.shared_text import shared_text
from ..functions.text import hits

BUCKET_SECONDS = 60


def frame_time(df: DataFrame) -> DataFrame:
    """``at_s``: the decoded time where known, else the requested second."""
    return df.withColumn("at_s", F.coalesce(F.col("decoded_s"), F.col("seconds").cast("double")))


def dyadic_nodes(low: Column, high: Column) -> Column:
    """The buckets from ``low`` up to, not including, ``high`` as few whole nodes: array of
    (level, node), a node of level k being 2^k buckets. There are two of a level at most."""
    def of_level(k: Column) -> Column:
        left = -F.call_function("shiftright", -low, k)
        right = F.call_function("shiftright", high, k)
        ends = F.array(F.when((left < right) & (left % 2 != 0), left), F.when((left < right) & (right % 2 != 0), right - 1))
        return F.transform(F.array_compact(ends), lambda node: F.struct(k.alias("level"), node.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), _level(high - low)), of_level))


def _level(buckets: Column) -> Column:
    """The largest level of a node within so many buckets."""
    return F.length(F.bin(buckets)) - 1


def caption_context_join(frames: DataFrame, captions: DataFrame, *, window: float = P.CONTEXT_SECONDS,
                         nearest: int = P.CONTEXT_CAPTIONS, bucket: float = BUCKET_SECONDS) -> DataFrame:
    """Per frame the ``nearest`` captions within ``window`` seconds of their interval.

    A dyadic interval index, so that a video spreads over its time and a caption of any
    length makes few rows: it is copied to the buckets that its widened ends touch (level
    -1), and what lies between them is cut into nodes of 2^k buckets. A frame asks its own
    bucket, and once each level that its video has. Within a node all captions are at
    distance 0 and only the first can be among the nearest, as of captions of one interval.
    """
    clean = captions.select(
        "video_id", "pos", "start_s",
        F.greatest(F.coalesce("duration_s", F.lit(0.0)), F.lit(0.0)).alias("duration_s"),
        F.trim(F.regexp_replace("text", r"[\r\n]", " ")).alias("text"),
    ).filter("text <> '' and start_s is not null")
    place = lambda second: F.floor(second / bucket).cast("long")
    start, end = F.col("start_s"), F.col("start_s") + F.col("duration_s")
    placed = clean.withColumns({"_s": place(start), "_e": place(end), "_lo": place(start - window), "_hi": place(end + window)})
    inside = F.col("_e") - F.col("_s") - 1
    edge = lambda low, high: F.transform(F.sequence(low, high), lambda at: F.struct(F.lit(-1).alias("level"), at.alias("node")))
    nodes = F.when(inside > 0, F.concat(
        edge(F.col("_lo"), F.col("_s")), edge(F.col("_e"), F.col("_hi")), dyadic_nodes(F.col("_s") + 1, F.col("_e")),
    )).otherwise(edge(F.col("_lo"), F.col("_hi")))
    spans = placed.select("video_id", "pos", "start_s", "duration_s", "text", F.explode(nodes).alias("_n")).select("*", "_n.level", "_n.node").drop("_n")
    alike = F.when(F.col("level") < 0, F.struct("start_s", "duration_s"))
    first = W.partitionBy("video_id", "level", "node", alike).orderBy("pos")
    spans = spans.withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") <= nearest).drop("_copy")

    levels = placed.filter(inside > 0).groupBy("video_id").agg(F.max(_level(inside)).alias("_most"))
    points = frame_time(frames).select("video_id", "frame_id", "at_s").join(levels, "video_id", "left")
    points = points.withColumn("level", F.explode(F.sequence(F.lit(-1), F.coalesce("_most", F.lit(-1))))).withColumn(
        "node", F.call_function("shiftright", place(F.col("at_s")), F.greatest(F.col("level"), F.lit(0))))
    distance = F.greatest(
        F.col("start_s") - F.col("at_s"),
        F.col("at_s") - F.col("start_s") - F.col("duration_s"),
        F.lit(0.0),
    )
    pairs = (
        points.select("video_id", "frame_id", "at_s", "level", "node")
        .join(spans, ["video_id", "level", "node"])
        .withColumn("distance", distance)
        .filter(F.col("distance") <= window)
    )
    order = W.partitionBy("video_id", "frame_id").orderBy("distance", "pos")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("video_id", "frame_id", "at_s", "rank", "distance", "pos", "start_s", "duration_s",
                F.col("text").alias("caption"))
    )


def ocr_pairs(context: DataFrame, ocr: DataFrame) -> DataFrame:
    """Every OCR line of a frame with each of its captions (at most ten), and the
    text they share."""
    lines = ocr.select("video_id", "frame_id", "ocr_pos", F.col("text").alias("ocr"))
    return context.join(lines, ["video_id", "frame_id"]).withColumn(
        "shared", longest_common_text(F.col("ocr"), F.col("caption"))
    )


def overlap_match(frames: DataFrame, context: DataFrame, lines: str = "lines") -> DataFrame:
    """Best (OCR line, caption) per frame; else the nearest caption as temporal only.

    ``lines`` is the frame's array of lines, so its text is matched in its own row. Frames
    with neither a match nor a caption are not candidates.
    """
    key = ["video_id", "frame_id"]
    captions = context.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "caption", F.col("start_s").alias("caption_s")))).alias("_captions"))
    joined = frames.select(*key, F.col(lines).alias("_lines")).join(captions, key)
    matched = joined.withColumn("m", shared_text(F.col("_lines"), F.transform("_captions", lambda c: c["caption"])))
    found = F.col("m").isNotNull()
    caption = F.get("_captions", F.coalesce("m.text", F.lit(0)))
    return matched.select(
        *key,
        F.when(found, F.col("m.shared")).otherwise("").alias("shared"),
        F.when(found, F.get("_lines", F.col("m.line"))).otherwise(F.coalesce(F.array_join("_lines", " "), F.lit(""))).alias("ocr"),
        caption["caption"].alias("caption"),
        caption["caption_s"].alias("caption_s"),
        F.when(found, "text-overlap").otherwise("temporal-only").alias("association"),
    )


def promo_frame_filter(frames: DataFrame, ocr: str = "ocr") -> DataFrame:
    """Leave out frames whose text hits two or more promotion groups."""
    return frames.filter(hits(F.coalesce(F.col(ocr), F.lit("")), P.PROMO_FRAME) < 2)


def _compact(col: Column) -> Column:
    return F.regexp_replace(normalize(col), r"(?U)[^\w]", "")


def _numbers(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(P.CLAIMED_NUMBER), F.lit(0))


def numbers_supported(note: Column, ocr: Column, caption: Column) -> Column:
    return F.size(F.array_except(_numbers(note), _numbers(F.concat(ocr, F.lit(" "), caption)))) == 0


def novelty_filter(notes: DataFrame, *, limit: float = P.SIMILARITY_LIMIT) -> DataFrame:
    """Notes (visual_evidence, ocr, caption) that add something of their own.

    The cheap rules run first on the JVM; only their survivors reach Python.
    """
    cheap = notes.filter(numbers_supported(F.col("visual_evidence"), F.col("ocr"), F.col("caption")))
    folded = cheap.withColumns({
        "_v": _compact(F.col("visual_evidence")),
        "_o": _compact(F.col("ocr")),
        "_c": _compact(F.col("caption")),
    })
    leads = r"\A" + "".join(f"(?:{lead})?" for lead in P.LEAD_INS)
    folded = folded.withColumn("_v", F.regexp_replace("_v", leads, ""))
    covers = lambda s: (F.col(s) != "") & (F.contains(F.col(s), F.col("_v")) | F.contains(F.col("_v"), F.col(s)))
    fresh = folded.filter((F.col("_v") != "") & ~covers("_o") & ~covers("_c"))
    scored = fresh.withColumn(
        "similarity",
        F.greatest(similarity(F.col("_v"), F.col("_o")), similarity(F.col("_v"), F.col("_c"))),
    )
    return scored.filter(F.col("similarity") < limit).drop("_v", "_o", "_c")


def frame_sources(frames: DataFrame, context: DataFrame, layout: DataFrame) -> DataFrame:
    """Every frame with its nearest caption or none, and its layout hint or a fixed text."""
    key = ["video_id", "frame_id"]
    nearest = context.filter("rank = 1").select(*key, "caption", F.col("start_s").alias("caption_s"))
    joined = frames.join(nearest, key, "left").join(layout.select(*key, "hints"), key, "left")
    return joined.select(
        *key,
        F.concat(F.lit(P.FRAME_TITLE), F.col("frame_id")).alias("title"),
        F.when(F.col("hints").isNotNull(), F.concat(F.col("hints"), F.lit(P.LAYOUT_SUFFIX)))
        .otherwise(P.NO_LAYOUT).alias("visual_evidence"),
        F.coalesce("caption", F.lit("")).alias("caption"),
        "caption_s",
        F.coalesce("ocr", F.lit("")).alias("ocr"),
        F.lit("").alias("shared"),
        F.lit("temporal-only").alias("association"),
    )
