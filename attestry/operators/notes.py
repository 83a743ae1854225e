"""Notes on captions: verbatim quotes, note rules, verdicts, merge over the timeline.

A reply belongs to one caption chunk, which its own limits keep small, so a quote is
searched in the joined text of that chunk's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fold import growing_fold, let
from ..functions.normalize import normalize, normalize_each
from ..functions.text import strip
from ..functions.typed_json import typed_json
from ..session import written
from .extract import scope_extracts

KEY = ["video_id", "chunk_no"]
NOTES_SCHEMA = (
    "notes array<struct<title:string,text:string,evidence:string,sources:array<string>>>, uncertainties string"
)


def _overlapping(ids: Column, pieces: Column, start: Column, end: Column) -> Column:
    """Ids of the pieces whose span in the joined text meets [start, end)."""
    state = {"i": F.lit(0), "offset": F.lit(0)}

    def step(acc: Column, piece: Column) -> dict[str, Column]:
        until = acc["offset"] + F.length(piece)
        meets = (acc["offset"] < end) & (until > start)
        return {
            "i": acc["i"] + 1, "offset": until,
            "refs": F.when(meets, F.array_append(acc["refs"], F.get(ids, acc["i"]))).otherwise(acc["refs"]),
        }

    return growing_fold(pieces, state, "refs", "string", step)


def located(ids: Column, pieces: Column, needle: Column) -> Column:
    """Ids of the units a folded quote covers; empty when it is not there."""
    none = F.array().cast("array<string>")
    at = F.position(needle, F.array_join(pieces, ""))
    return let(
        at,
        lambda found: F.when(
            (found > 0) & (needle != ""),
            _overlapping(ids, pieces, found - 1, found - 1 + F.length(needle)),
        ).otherwise(none),
    )


def quote_locate(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(video_id, chunk_no, note_no, evidence) → the unit ids that hold the quote.

    A quote of an unknown chunk is kept, with no ids.
    """
    held = chunks.select(*KEY, F.transform("units", lambda u: u["unit_id"]).alias("_ids"),
                         F.transform("units", lambda u: u["text"]).alias("_texts"))
    folded = held.withColumn("_pieces", normalize_each(F.col("_texts"))).drop("_texts")
    return (
        quotes.join(folded, KEY, "left")
        .withColumn("_needle", normalize(F.col("evidence")))
        .withColumn("refs", F.coalesce(
            located(F.col("_ids"), F.col("_pieces"), F.col("_needle")), F.array().cast("array<string>")))
        .drop("_ids", "_pieces", "_needle")
    )


def _broken(note: Column, refs: Column, ids: Column) -> Column:
    sized = lambda c, low, high: F.coalesce(F.length(strip(c)).between(low, high), F.lit(False))
    known = F.coalesce(
        F.size(note["sources"]).between(1, 3) & (F.size(F.array_except(note["sources"], ids)) == 0), F.lit(False)
    )
    return (
        F.when(~sized(note["text"], 8, 900), "bad text")
        .when(strip(note["text"]).rlike(P.VAGUE_NOTE), "vague")
        .when(~known, "unknown source")
        .when(~sized(note["evidence"], 6, 1200), "bad quote")
        .when(F.size(refs) == 0, "quote not found")
    )


def note_validate(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(video_id, chunk_no, answer JSON) → kept notes per reply.

    ``outline`` and ``points`` hold the kept copies, ``dropped`` counts failed copies,
    ``reject_reason`` is set when no chunk has the reply's key, the shape is wrong or
    nothing is left. A title is required of the outline copy only.
    """
    held = chunks.select(*KEY, F.transform("units", lambda u: u["unit_id"]).alias("_ids"),
                         F.transform("units", lambda u: u["text"]).alias("_texts"))
    rows = (
        replies.join(held, KEY, "left")
        .withColumn("_a", typed_json(F.col("answer"), NOTES_SCHEMA))
        .withColumn("_notes", F.col("_a.notes"))
        .withColumn("_pieces", normalize_each(F.col("_texts")))
        .withColumn("_needles", normalize_each(F.transform("_notes", lambda n: F.coalesce(n["evidence"], F.lit("")))))
    )

    def judged(note: Column, i: Column) -> Column:
        refs = located(F.col("_ids"), F.col("_pieces"), F.get("_needles", i))
        return let(
            refs,
            lambda r: F.struct(
                (i + 1).alias("n"), note["title"].alias("title"), note["text"].alias("text"),
                note["evidence"].alias("evidence"), r.alias("refs"), _broken(note, r, F.col("_ids")).alias("rule"),
                F.coalesce(F.length(strip(note["title"])).between(2, 80), F.lit(False)).alias("titled"),
            ),
        )

    checked = rows.withColumn("_j", F.transform("_notes", judged))
    points = F.filter("_j", lambda n: n["rule"].isNull())
    outline = F.filter("_j", lambda n: n["rule"].isNull() & n["titled"])
    shape = F.col("_notes").isNull() | F.col("_a.uncertainties").isNull()
    kept = F.size(points) + F.size(outline)
    return checked.select(
        *KEY,
        F.when(~shape, outline).alias("outline"),
        F.when(~shape, points).alias("points"),
        F.when(~shape, 2 * F.size("_j") - kept).alias("dropped"),
        F.col("_a.uncertainties").alias("uncertainties"),
        F.when(F.col("_ids").isNull(), "unknown chunk").when(shape, "bad shape").when((F.size("_j") > 0) & (kept == 0), "nothing verified").alias("reject_reason"),
    )


def explode_notes(validated: DataFrame, section: str) -> DataFrame:
    fine = validated.filter(F.col("reject_reason").isNull())
    return fine.select(*KEY, F.explode(section).alias("j")).select(
        *KEY, "j.n", "j.title", "j.text", "j.evidence", "j.refs"
    )


def claim_gate(validated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Kept notes after their verdicts, as rows (…, section, n, extractive, failed).

    An unsupported point is replaced by its quoted original. With any point, the outline
    is rebuilt from the supported ones. A missing verdict fails the whole chunk.
    """
    fine = validated.filter(F.col("reject_reason").isNull())
    copies = F.concat(*[
        F.transform(name, lambda j: F.struct(F.lit(name).alias("section"), j.alias("j")))
        for name in ("points", "outline")
    ])
    rows = fine.select(*KEY, F.explode(copies).alias("c")).select(
        *KEY, "c.section", "c.j.n", "c.j.title", "c.j.text", "c.j.evidence", "c.j.refs"
    )
    point = F.col("section") == "points"
    chunk = W.partitionBy(*KEY)
    judged = (
        rows.join(verdicts, [*KEY, "n"], "left")
        .withColumn("failed", F.max(point & F.col("supported").isNull()).over(chunk))
        .withColumn("_any", F.max(point).over(chunk))
        .filter(point | ~F.col("_any"))
    )
    quoted = point & ~F.coalesce("supported", F.lit(False))
    placed = F.when(quoted, F.array(F.lit("points"))).when(point, F.array(F.lit("points"), F.lit("outline"))).otherwise(
        F.array(F.lit("outline"))
    )
    return judged.select(
        *KEY, "n",
        F.when(quoted, P.EXTRACT_TITLE).otherwise(F.col("title")).alias("title"),
        F.when(quoted, F.format_string(P.EXTRACT_TEXT, F.col("evidence"))).otherwise(F.col("text")).alias("text"),
        "evidence", "refs", quoted.alias("extractive"), "failed",
        F.explode(placed).alias("section"),
    )


def _with_links(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``at_s`` (earliest cited second) and ``links`` (one per reference, in order)."""
    refs = notes.select(*KEY, "section", "n", F.posexplode("refs").alias("i", "unit_id"))
    spots = blocks.select("video_id", "unit_id", F.coalesce("time", "unit_id").alias("time"), "url",
                          F.coalesce(F.col("seconds"), (F.col("unit_no") - 1).cast("long")).alias("at"))
    link = F.concat(F.lit("["), F.col("time"), F.lit("]("), F.col("url"), F.lit(")"))
    joined = refs.join(spots, ["video_id", "unit_id"]).groupBy(*KEY, "section", "n").agg(
        F.min("at").alias("at_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", link.alias("l")))), lambda x: x["l"]), " ").alias("links"),
    )
    return notes.join(joined, [*KEY, "section", "n"])


def note_timeline_merge(gated: DataFrame, blocks: DataFrame, replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """All notes of a video in time order without repeats, as report rows.

    (video_id, section, chunk_no, at_s, n, line); repeats are told by folded text and the
    first copy wins, found as a minimum so copies shrink before the shuffle.
    """
    kept = gated.filter(~F.col("failed")).withColumn(
        "section", F.when(F.col("section") == "outline", "outline").when(F.col("extractive"), "extract").otherwise("point")
    )
    ready = _with_links(kept, blocks).withColumn("_marker", normalize(F.col("text")))
    quote = F.col("evidence")
    line = (
        F.when(F.col("section") == "outline", F.concat(F.lit("- **"), F.col("title"), F.lit("** "), F.col("links")))
        .when(F.col("section") == "extract",
              F.concat(F.lit("- 原句參考（AI 解讀未通過核對）："), F.col("evidence"), F.lit(" "), F.col("links")))
        .otherwise(F.concat(F.lit("- "), F.col("text"), F.lit(" "), F.col("links"),
                            F.lit("\n  字幕依據：「"), quote, F.lit("」")))
    )
    order = F.struct("chunk_no", "at_s", "n")
    notes = (
        ready.withColumn("line", line)
        .groupBy("video_id", (F.col("section") == "outline").alias("_o"), "_marker")
        .agg(F.min_by(F.struct("section", "chunk_no", "at_s", "n", "line"), order).alias("r"))
        .select("video_id", "r.*")
    )
    said = strip(F.col("uncertainties"))
    unsure = (
        replies.withColumn("line", said).filter(~F.col("line").isin(*P.EMPTY_UNCERTAINTY))
        .groupBy("video_id", "line").agg(F.min("chunk_no").alias("chunk_no"))
        .select("video_id", F.lit("uncertain").alias("section"), "chunk_no", F.lit(0).cast("long").alias("at_s"),
                F.lit(0).alias("n"), F.concat(F.lit("- "), F.col("line")).alias("line"))
    )
    lost = gated.filter("failed").select(*KEY).unionByName(
        replies.filter(F.col("reject_reason").isNotNull()).select(*KEY)
    ).distinct()
    failed = chunks.join(lost, KEY, "left_semi").select(*KEY, F.posexplode("units").alias("i", "u")).select(
        "video_id", F.lit("failed").alias("section"), "chunk_no",
        F.coalesce(F.col("u.seconds"), F.lit(0)).cast("long").alias("at_s"), F.col("i").alias("n"),
        F.concat(F.lit("- ["), F.coalesce(F.col("u.time"), F.col("u.unit_id")), F.lit("]("), F.col("u.url"),
                 F.lit(")："), F.col("u.text")).alias("line"),
    )
    return notes.unionByName(unsure).unionByName(failed)


#: Sections of a video's report, in order.
REPORT_SECTIONS = ("summary", "outline", "point", "uncertain", "extract", "failed")


def video_report(merged: DataFrame, blocks: DataFrame) -> DataFrame:
    """The whole report of every video in ``blocks``, one row per line: (video_id, section_no,
    section, n, line), ordered by (section_no, n).

    ``merged`` are the rows of ``note_timeline_merge``. An outline or points that are missing
    beside the other have a fixed line. A video with neither falls back to the extract of its
    blocks, and keeps only the quotes that are still to be checked. Both the merged rows and the
    blocks without notes are read several times, so they are written out once.
    """
    merged = written(merged, "merged")
    state = merged.groupBy("video_id").agg(
        F.bool_or(F.col("section") == "outline").alias("_outline"), F.bool_or(F.col("section") == "point").alias("_point"))
    videos = blocks.select("video_id").distinct().join(state, "video_id", "left").select(
        "video_id", F.coalesce("_outline", F.lit(False)).alias("_outline"), F.coalesce("_point", F.lit(False)).alias("_point"))
    videos = videos.withColumn("_told", F.col("_outline") | F.col("_point"))
    lines = merged.join(videos.select("video_id", "_told"), "video_id").filter(F.col("_told") | (F.col("section") == "extract"))
    place = W.partitionBy("video_id", "section").orderBy("chunk_no", "at_s", "n")
    lines = lines.select("video_id", "section", F.row_number().over(place).alias("n"), "line")
    fixed = videos.filter("_told and not (_outline and _point)").select(
        "video_id", F.when(F.col("_outline"), "point").otherwise("outline").alias("section"), F.lit(1).alias("n"),
        F.when(F.col("_outline"), P.NO_MORE_POINTS).otherwise(P.NO_OUTLINE).alias("line"))
    silent = written(blocks.join(videos.filter("not _told"), "video_id", "left_semi").select("video_id", "unit_no", "unit_id", "text"), "silent")
    extract = scope_extracts(silent, "video_id").select("video_id", F.lit("summary").alias("section"), F.lit(1).alias("n"), F.col("summary").alias("line"))
    number = F.array_position(F.array(*map(F.lit, REPORT_SECTIONS)), F.col("section")) - 1
    return lines.unionByName(fixed).unionByName(extract).select("video_id", number.cast("int").alias("section_no"), "section", "n", "line")
