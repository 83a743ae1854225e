"""Frame sampling, gating, key-frame selection and galleries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clock, watch_link
from ..session import written


def _evenly(start: Column, end: Column, count: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.bround(start + (end - start) * i / (count - 1), 2),
    )


def sample_timestamps(videos: DataFrame, *, max_frames: int = P.MAX_FRAMES,
                      max_duration: float | None = None) -> DataFrame:
    """(video_id, duration_s) → retained and candidate times, or a reject reason."""
    d = F.col("duration_s")
    bad = F.coalesce((d <= 0) | (F.lit(False) if max_duration is None else d > max_duration), F.lit(True))
    count = F.least(
        F.lit(max_frames), F.greatest(F.lit(3), F.bround(F.when(~bad, d) / 90).cast("int") + 2)
    )
    retained = F.when(count == 1, F.array(F.bround(d / 2, 2))).otherwise(
        _evenly(F.least(F.lit(5.0), d * 0.05), F.greatest(d * 0.92, d - 5), count)
    )
    wide = F.least(F.lit(P.MAX_FRAMES * 4), count * 4)
    candidates = _evenly(F.least(F.lit(3.0), d * 0.03), F.greatest(d * 0.97, d - 3), wide)
    return videos.select(
        "video_id", "duration_s",
        F.when(~bad, retained).alias("retained"),
        F.when(~bad, candidates).alias("candidates"),
        F.when(bad, "duration out of range").alias("reject_reason"),
    )


KEPT_SCHEMA = "series long, chunk long, pos long, selection_score double, last array<double>"
GATE_CHUNK = 4096


def _gate(min_mean: float, min_std: float, min_change: float, first_change: float):
    """Walk one stretch of a series from the last frame kept before it."""

    def walk(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["series", "chunk", "pos", "selection_score", "last"])
        rows = rows.sort_values("pos")
        series, chunk = int(rows["series"].iloc[0]), int(rows["chunk"].iloc[0])
        before = entry["last"].iloc[0] if len(entry) else None
        last = None if before is None else np.asarray(before, dtype=float)
        out = []
        for pos, vector, edge in zip(rows["pos"], rows["vector"], rows["edge"]):
            now = np.asarray(vector, dtype=float)
            spread = now.std()
            if now.mean() < min_mean or spread < min_std:
                continue
            change = first_change if last is None else np.abs(now - last).mean()
            if last is not None and change < min_change:
                continue
            last = now
            out.append((series, chunk, int(pos), round(float(change + spread + min(edge, 500.0) / 10), 3), None))
        out.append((series, chunk, None, None, None if last is None else last.tolist()))
        frame = pd.DataFrame(out, columns=["series", "chunk", "pos", "selection_score", "last"])
        return frame.astype({"pos": "Int64"})

    return walk


def frame_gate(features: DataFrame, *, min_mean: float = 12.0, min_std: float = 8.0,
               min_change: float = 7.0, first_change: float = 20.0, chunk: int = GATE_CHUNK) -> DataFrame:
    """Drop blank frames, and frames too close to the last kept one of their series.

    (series, pos, vector, edge) → kept rows with their selection score. What is kept
    depends on the frame kept before, so a series is a chain. Its stretches of ``chunk``
    positions are walked in parallel on a guess of the frame they start from, and only
    stretches whose guess proves wrong are walked again, until none is: the result is
    that of one walk, and no task ever holds more than a stretch. A series of one
    stretch, as a video's few dozen frames are, needs a single pass.
    """
    walk = _gate(min_mean, min_std, min_change, first_change)
    key = ["series", "chunk"]
    rows = features.select("series", F.floor(F.col("pos") / chunk).alias("chunk"), "pos", "vector", "edge")

    def walked(part: DataFrame, entries: DataFrame) -> DataFrame:
        return part.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(walk, KEPT_SCHEMA)

    rows = written(rows, "gate-rows")
    used = rows.select(*key).distinct().withColumn("last", F.lit(None).cast("array<double>"))
    kept = written(walked(rows, used), "gate")
    while True:
        along = W.partitionBy("series").orderBy("chunk")
        entries = kept.filter("pos is null").select(*key, F.lag("last").over(along).alias("last"))
        wrong = written(
            entries.alias("e").join(used.alias("u"), key).filter(~F.col("e.last").eqNullSafe(F.col("u.last")))
            .select(*key, F.col("e.last").alias("last")), "gate-wrong")
        if wrong.isEmpty():
            return kept.filter("pos is not null").select("series", "pos", "selection_score")
        used = written(used.join(wrong, key, "left_anti").unionByName(wrong), "gate-used")
        again = walked(rows.join(wrong, key, "left_semi"), wrong)
        kept = written(kept.join(wrong, key, "left_anti").unionByName(again), "gate")


def keyframe_select(candidates: DataFrame, *, count: int = P.MAX_FRAMES) -> DataFrame:
    """(video_id, pos, at_s, score, duration_s) → the frames to keep, by time.

    Each of ``count`` time segments (both ends included) gives its best frame, or the
    nearest one when empty; free places are filled by score. A segment is a max/min
    aggregate and the fill a map-side limited rank, so a long video is never gathered.
    """
    k = F.lit(count)
    at, duration, score, pos = (F.col(c) for c in ("at_s", "duration_s", "score", "pos"))
    home = F.least(F.greatest(F.floor(F.coalesce(F.try_divide(at * count, duration), F.lit(0.0))).cast("int"), F.lit(0)), k - 1)
    spread = candidates.withColumn("_home", home).withColumn(
        "seg",
        F.explode(F.sequence(F.greatest(F.col("_home") - 1, F.lit(0)), F.least(F.col("_home") + 1, k - 1))),
    )
    low, high = duration * F.col("seg") / count, duration * (F.col("seg") + 1) / count
    me = F.struct("pos", "at_s", "score")
    inside = (low <= at) & (at <= high)
    at_home = F.col("seg") == F.col("_home")
    segments = spread.groupBy("video_id", "seg").agg(
        F.max_by(F.when(inside, me), F.when(inside, F.struct(score, -F.abs(at - (low + high) / 2), -pos))).alias("best"),
        F.min_by(F.when(at_home, me), F.when(at_home, F.struct(at, pos))).alias("first"),
        F.max_by(F.when(at_home, me), F.when(at_home, F.struct(at, -pos))).alias("last"),
        F.count_if(at_home).alias("n"),
        F.max("duration_s").alias("duration_s"),
    )
    per_video = segments.groupBy("video_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("seg", "best")))).alias("best"),
        F.array_compact(F.flatten(F.collect_list(F.array("first", "last")))).alias("edges"),
        F.sum("n").alias("n"),
        F.max("duration_s").alias("duration_s"),
    )

    def winner(i: Column) -> Column:
        middle = (F.col("duration_s") * i / count + F.col("duration_s") * (i + 1) / count) / 2
        near = F.array_min(
            F.transform(
                F.col("edges"),
                lambda e: F.struct(F.abs(e["at_s"] - middle).alias("d"), e["pos"].alias("p"), e.alias("e")),
            )
        )["e"]
        return F.coalesce(F.try_element_at(F.col("best"), i), near)

    winners = per_video.withColumn("chosen", F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), winner)))

    by_score = W.partitionBy("video_id").orderBy(F.desc("score"), "pos")
    top = (
        candidates.select("video_id", me.alias("me"), "score", "pos")
        .withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") <= 2 * count)
        .groupBy("video_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "me"))).alias("top"))
    )
    ranked = F.transform("top", lambda t: t["me"])
    fill = F.slice(
        F.filter(ranked, lambda m: ~F.exists(F.col("chosen"), lambda c: c["pos"] == m["pos"])),
        F.lit(1), k - F.size("chosen"),
    )
    kept = F.when(F.col("n") <= count, ranked).otherwise(F.concat("chosen", fill))
    by_time = F.sort_array(F.transform(kept, lambda m: F.struct(m["at_s"].alias("at_s"), m["pos"].alias("pos"), m["score"].alias("score"))))
    return (
        winners.join(top, "video_id")
        .select("video_id", F.posexplode_outer(by_time).alias("n", "f"))
        .filter(F.col("f").isNotNull())
        .select("video_id", (F.col("n") + 1).alias("n"), "f.*")
    )


def frame_gallery(frames: DataFrame) -> DataFrame:
    """One gallery entry per frame: heading with its time link, and the image line."""
    stamp = clock(F.col("seconds"))
    return frames.select(
        "video_id", "frame_id", "seconds",
        F.concat(F.lit("### ["), stamp, F.lit("]("), watch_link(F.col("code"), F.col("seconds")), F.lit(")")).alias("heading"),
        F.concat(F.lit("!["), stamp, F.lit(" 畫面]("), F.col("file"), F.lit(")")).alias("image"),
    )


def gallery_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("decoder_status") == "hardware-verified").alias("hardware"),
    )


def unnoted_frame_lines(frames: DataFrame, notes: DataFrame, layout: DataFrame) -> DataFrame:
    """Hint and visible-text lines for videos where no note survived."""
    bare = frames.join(notes.select("video_id").distinct(), "video_id", "left_anti")
    link = F.concat(
        F.lit("- ["), F.format_string("%02d:%02d", F.floor(F.col("seconds") / 60).cast("long"), F.col("seconds") % 60),
        F.lit("]("), watch_link(F.col("code"), F.col("seconds")), F.lit(") "),
    )
    hints = bare.join(layout, ["video_id", "frame_id"]).select(
        "video_id", "frame_id", F.lit("hint").alias("kind"),
        F.concat(link, F.col("hints"), F.lit("（依文字位置推定，請核對影格）")).alias("line"),
    )
    seen = bare.filter(F.coalesce(F.col("ocr"), F.lit("")) != "").select(
        "video_id", "frame_id", F.lit("ocr").alias("kind"),
        F.concat(
            link, F.replace("ocr", F.lit("\n"), F.lit("、")),
            F.lit("（OCR 可能誤字）"),
        ).alias("line"),
    )
    return hints.unionByName(seen)

