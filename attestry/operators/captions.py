"""Caption snippets to transcript lines, blocks, samples and chunks.

Lines, captions, blocks and chunks are rows, so a video may have any number of them; only
``transcript_text`` makes one row of a video. Feeds without an end are cut by the caption stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fold import let
from ..functions.text import clock, hits, is_blank, lines_of, numbered, strip, watch_link
from ..session import written
from .packing import packed
from .prefix import running
from .segment import source_units

SEPARATOR = "\n\n"


def speech_snippets(segments: DataFrame) -> DataFrame:
    """Recognised speech (start_s, end_s, text) as snippets."""
    return (
        segments.withColumn("text", strip(F.coalesce("text", F.lit(""))))
        .filter(F.col("text") != "")
        .withColumn("duration_s", F.col("end_s") - F.col("start_s"))
        .drop("end_s")
    )


def transcript_format(snippets: DataFrame) -> DataFrame:
    """One transcript line per non-blank snippet: (video_id, pos, seconds, line)."""
    text = strip(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = snippets.select(
        "video_id", "pos", "code",
        F.greatest(F.lit(0), F.col("start_s").cast("long")).cast("long").alias("seconds"),
        text.alias("text"),
    ).filter(F.col("text") != "")
    return rows.select(
        "video_id", "pos", "seconds",
        F.concat(
            F.lit("["), clock(F.col("seconds")), F.lit("]("),
            watch_link(F.col("code"), F.col("seconds")), F.lit(") "), F.col("text"),
        ).alias("line"),
    )


def transcript_rejects(snippets: DataFrame) -> DataFrame:
    """Videos without any usable caption text."""
    return (
        snippets.groupBy("video_id")
        .agg(F.bool_and(is_blank(F.col("text"))).alias("empty"))
        .filter("empty")
        .select("video_id", F.lit("no caption text").alias("reason"))
    )


def transcript_text(lines: DataFrame, *, max_chars: int | None = None) -> DataFrame:
    """The transcript text of each video; with ``max_chars`` no longer than that, and
    ``truncated`` tells whether anything was left out."""
    if max_chars is None:
        whole = lines.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"))
        return whole.select(
            "video_id", F.array_join(F.transform("_l", lambda s: s["line"]), SEPARATOR).alias("text"),
            F.lit(False).alias("truncated"),
        )
    size = F.length("line") + len(SEPARATOR)
    reach = running(lines.select("video_id", "pos", "line"), ["video_id"], "pos", value=size, total="upto")
    inside = F.when(F.col("upto") - size < max_chars, F.struct("pos", "line"))
    whole = reach.groupBy("video_id").agg(
        F.sort_array(F.collect_list(inside)).alias("_l"), F.max("upto").alias("_upto")
    )
    return whole.select(
        "video_id",
        F.substring(F.array_join(F.transform("_l", lambda s: s["line"]), SEPARATOR), 1, max_chars).alias("text"),
        (F.col("_upto") - len(SEPARATOR) > max_chars).alias("truncated"),
    )


def captions_array(text: Column) -> Column:
    """Captions of a transcript text: array of (time, url, seconds, text)."""
    parsed = F.transform(
        lines_of(text),
        lambda line: let(
            strip(line),
            lambda s: F.struct(
                F.regexp_extract(s, P.CAPTION_LINE, 1).alias("time"),
                F.regexp_extract(s, P.CAPTION_LINE, 2).alias("url"),
                F.regexp_extract(s, P.CAPTION_LINE, 3).try_cast("long").alias("seconds"),
                F.regexp_extract(s, P.CAPTION_LINE, 4).alias("text"),
            ),
        ),
    )
    return F.filter(
        parsed,
        lambda c: (c["time"] != "") & (strip(c["text"]) != "")
        & ~F.lower(strip(c["text"])).isin(*P.NOISE_CAPTIONS),
    )


def caption_parse(lines: DataFrame) -> DataFrame:
    """One row per caption in lines (video_id, pos, line), numbered from 1 within its video:
    (video_id, n, time, url, seconds, text)."""
    parts = lines.select("video_id", "pos", F.posexplode(captions_array(F.col("line"))).alias("_part", "_c"))
    counted = running(parts.select("video_id", "pos", "_part", "_c.*"), ["video_id"], "pos", ties=["_part"], number="n")
    return counted.select("video_id", F.col("n").cast("int").alias("n"), "time", "url", "seconds", "text")


def caption_blocks(lines: DataFrame, *, seconds: int = P.BLOCK_SECONDS, chars: int = P.BLOCK_CHARS, **options) -> DataFrame:
    """Captions joined into blocks, one row each; a block closes ``seconds`` after its own
    start. A video without any caption in its lines has plain source units instead."""
    captions = written(caption_parse(lines), "captions")
    packs = packed(captions, ["video_id"], "n", F.length("text"), max_size=chars, at=F.col("seconds"), max_span=seconds,
                   joiner=1, name="unit_no", **options)
    first = F.min_by(F.struct("url", "time", "seconds"), "n")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda c: c["text"]), " ")
    blocks = packs.groupBy("video_id", "unit_no").agg(joined.alias("text"), first.alias("_f"), F.count(F.lit(1)).alias("n_captions"))
    silent = lines.join(captions.select("video_id").distinct(), "video_id", "left_anti")
    plain = source_units(transcript_text(silent).select("video_id", "text", F.lit("").alias("url")))
    return blocks.select(
        "video_id", F.col("unit_no").cast("int").alias("unit_no"), numbered("S", F.col("unit_no")).alias("unit_id"), "text",
        "_f.*", F.col("n_captions").cast("int").alias("n_captions"),
    ).select("video_id", "unit_no", "unit_id", "text", "url", "time", "seconds", "n_captions").unionByName(plain.select(
        "video_id", "unit_no", "unit_id", "text", "url", F.lit(None).cast("string").alias("time"),
        F.lit(None).cast("long").alias("seconds"), F.lit(0).alias("n_captions")))


def timeline_sample(blocks: DataFrame, *, budget: int = P.MODEL_BUDGET) -> DataFrame:
    """Every block of a video when they fit, else an even spread over its timeline; ``sampled``
    tells which. As many blocks are taken as fit at the longest one's length, so together they
    fit too; only a single block can be too long, and is then left out."""
    totals = blocks.groupBy("video_id").agg(
        F.sum(F.length("text")).alias("_total"), F.max(F.length("text")).alias("_longest"), F.count(F.lit(1)).alias("_n"))
    count = F.greatest(F.lit(1), F.expr(f"{budget} div greatest(_longest, 1)"))
    over = totals.filter(F.col("_total") > budget).withColumn("_count", count)
    spot = F.bround(F.col("i") * (F.col("_n") - 1) / F.greatest(F.col("_count") - 1, F.lit(1))).cast("int") + 1
    spots = over.select("video_id", "_n", "_count", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("i")).select(
        "video_id", spot.alias("unit_no")).distinct()
    whole = blocks.join(totals.filter(F.col("_total") <= budget).select("video_id"), "video_id").withColumn("sampled", F.lit(False))
    spread = blocks.filter(F.length("text") <= budget).join(spots, ["video_id", "unit_no"]).withColumn("sampled", F.lit(True))
    return whole.unionByName(spread)


def is_closing_promo(text: Column) -> Column:
    return (F.length(text) < P.CLOSING_PROMO_CHARS) & (hits(text, P.CLOSING_PROMO) >= 2)


def closing_promo_trim(blocks: DataFrame) -> DataFrame:
    """Blocks without a short closing call to action."""
    return blocks.join(closing_promos(blocks).filter("promo").select("video_id", "unit_no"), ["video_id", "unit_no"], "left_anti")


def closing_promos(blocks: DataFrame) -> DataFrame:
    """The last block of each video, (video_id, unit_no), and whether it is a ``promo``."""
    last = blocks.groupBy("video_id").agg(F.max_by(F.struct("unit_no", "text"), "unit_no").alias("_u"))
    return last.select("video_id", "_u.unit_no", is_closing_promo(F.col("_u.text")).alias("promo"))


def caption_chunks(blocks: DataFrame, *, chars: int = P.CAPTION_CHUNK_CHARS, seconds: int = P.CAPTION_CHUNK_SECONDS,
                   **options) -> DataFrame:
    """Blocks, numbered from 1 by ``unit_no``, with the chunk they belong to: a chunk closes by
    size, or by time since its own start."""
    return packed(blocks, ["video_id"], "unit_no", F.length("text"), max_size=chars,
                  at=F.coalesce("seconds", F.lit(0)), max_span=seconds, name="chunk_no", **options)


def chunk_units(chunks: DataFrame) -> DataFrame:
    """One row per chunk, which its own limits keep small, with its blocks as ``units``."""
    unit = F.struct("unit_no", "unit_id", "text", "url", "time", "seconds", "n_captions")
    return chunks.groupBy("video_id", F.col("chunk_no").cast("int").alias("chunk_no")).agg(F.sort_array(F.collect_list(unit)).alias("units"))


def track_select(tracks: DataFrame) -> DataFrame:
    """Best caption track per video: language rank, manual before generated, first."""
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(x) for x in P.TRACK_LANGUAGES]), F.col("language")), F.lit(0)),
        F.lit(P.OTHER_LANGUAGE_RANK),
    )
    best = F.min_by(F.struct("pos", "language", "generated"), F.struct(rank, "generated", "pos"))
    return tracks.groupBy("video_id").agg(best.alias("_t")).select("video_id", "_t.*")
