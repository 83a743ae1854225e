"""Evidence records: notes tied to frames and to the nearest original caption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse, numbered
from .prefix import running

STRETCH_SECONDS = 3600.0


def nearest_by_time(left: DataFrame, right: DataFrame, keys: list[str], *, at: str, start: str,
                    pos: str, width: float = STRETCH_SECONDS) -> DataFrame:
    """Add ``_near`` to each left row: the right (start_s, pos, duration_s) closest to
    ``at`` among equal keys, the smaller ``pos`` on ties, NULL when the key has none.

    Distinct times of both sides are sorted once, without forming pairs: within a
    stretch of ``width`` seconds windows look back and ahead, and what lies in other
    stretches comes from a per-stretch aggregate, so a key that holds most rows spreads
    over its stretches and copies are folded before they are shuffled.
    """
    stretch = lambda c: F.floor(F.col(c) / width)
    by = [*keys, "_stretch"]
    value = F.struct(F.col(start).cast("double").alias("start_s"), F.col(pos).alias("pos"),
                     F.col("duration_s").alias("duration_s"))
    points = right.groupBy(*keys, F.col(start).cast("double").alias("_t")).agg(
        F.min_by(value, F.col(pos)).alias("_value")
    ).withColumn("_stretch", stretch("_t"))
    asked = left.select(*keys, F.col(at).cast("double").alias("_t")).distinct().withColumn("_stretch", stretch("_t"))

    edges = points.groupBy(*by).agg(F.min_by("_value", "_t").alias("_lo"), F.max_by("_value", "_t").alias("_hi"))
    # Looking ahead is looking back in descending order: a frame that ends at the current
    # row is extended row by row, one that starts there would be read anew for every row.
    past = (W.unboundedPreceding, -1)
    along, ahead = W.partitionBy(*keys).orderBy("_stretch"), W.partitionBy(*keys).orderBy(F.desc("_stretch"))
    outer = asked.select(*by).distinct().join(edges, by, "full").select(
        *by,
        F.last("_hi", ignorenulls=True).over(along.rowsBetween(*past)).alias("_before0"),
        F.last("_lo", ignorenulls=True).over(ahead.rowsBetween(*past)).alias("_after0"),
    )
    nothing = F.lit(None).cast(points.schema["_value"].dataType).alias("_value")
    both = asked.select(*by, "_t", F.lit(1).alias("_side"), nothing).unionByName(
        points.select(*by, "_t", F.lit(0).alias("_side"), "_value")
    )
    upto = (W.unboundedPreceding, W.currentRow)
    inner = W.partitionBy(*by).orderBy("_t", "_side")
    later = W.partitionBy(*by).orderBy(F.desc("_t"), F.desc("_side"))
    seen = both.select(
        *by, "_t", "_side",
        F.last("_value", ignorenulls=True).over(inner.rowsBetween(*upto)).alias("_before"),
        F.last("_value", ignorenulls=True).over(later.rowsBetween(*upto)).alias("_after"),
    ).filter("_side = 1")
    before, after = F.coalesce("_before", "_before0"), F.coalesce("_after", "_after0")
    far = lambda v: F.struct(F.abs(v["start_s"] - F.col("_t")), v["pos"])
    chosen = (
        F.when(before.isNull(), after)
        .when(after.isNull() | (far(before) <= far(after)), before)
        .otherwise(after)
    )
    answers = seen.join(outer, by).select(*keys, F.col("_t").alias("_at"), chosen.alias("_near"))
    return (
        left.withColumn("_at", F.col(at).cast("double"))
        .join(answers, [*keys, "_at"], "left")
        .select(*left.columns, "_near")
    )


def evidence_records(notes: DataFrame, frames: DataFrame, snippets: DataFrame) -> DataFrame:
    """Notes (video_id, pos, frame_id, title, visual_evidence, caption, caption_s, ocr,
    shared, association) with their frame and the original snippet whose text equals the
    caption, nearest to the anchor time.

    ``sha256`` of the frames and ``provider`` and ``model`` of the notes are carried along,
    NULL where the tables have no such column. A note of an unknown frame is kept, with
    ``decoder_status`` "no such frame".
    """
    given = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    frame = frames.select(
        "video_id", "frame_id", "seconds", "decoded_s", given(frames, "sha256").alias("frame_sha256"),
        F.coalesce("decoder_status", F.lit("unknown")).alias("decoder_status"),
    )
    notes = notes.withColumns({c: given(notes, c) for c in ("provider", "model")})
    anchored = (
        running(notes, ["video_id"], "pos", number="_n").join(frame, ["video_id", "frame_id"], "left")
        .withColumn("_clean", collapse(F.col("caption")))
        .withColumn("_anchor", F.coalesce(
            F.col("caption_s").cast("double"), F.when(F.col("decoded_s") != 0, F.col("decoded_s")),
            F.col("seconds").cast("double"),
        ))
    )
    clean = snippets.select("video_id", collapse(F.col("text")).alias("_clean"), "start_s", "pos", "duration_s")
    placed = nearest_by_time(anchored, clean, ["video_id", "_clean"], at="_anchor", start="start_s", pos="pos")
    found = F.col("_near").isNotNull()
    return placed.select(
        "video_id",
        numbered("E", F.col("_n")).alias("evidence_id"),
        "frame_id", "frame_sha256", "seconds", "decoded_s",
        F.coalesce("decoder_status", F.lit("no such frame")).alias("decoder_status"), "title",
        F.col("visual_evidence").alias("summary"),
        F.col("caption").alias("caption_text"),
        F.coalesce(F.col("_near.start_s"), F.col("caption_s").cast("double")).alias("caption_start"),
        F.col("_near.duration_s").alias("caption_duration"),
        F.when(found, "source-timestamp").otherwise("markdown-whole-seconds").alias("caption_precision"),
        "ocr", F.col("shared").alias("shared_text"), "association", "provider", "model",
    )


def evidence_stats(records: DataFrame) -> DataFrame:
    """Counts per video and the few distinct decoder states."""
    overlap = F.count_if(F.col("association") == "text-overlap")
    return records.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total"),
        overlap.alias("text_overlap"),
        (F.count(F.lit(1)) - overlap).alias("temporal_only"),
        F.array_join(F.array_sort(F.collect_set("decoder_status")), ", ").alias("decoders"),
    )
