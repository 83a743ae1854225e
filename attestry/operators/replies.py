"""Model replies as a table: decoding, shape checks, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fold import let
from ..functions.text import strip
from ..functions.typed_json import typed_json

ENVELOPE_SCHEMA = (
    "done_reason string, message struct<content:string>, "
    "choices array<struct<finish_reason:string,message:struct<content:string,refusal:string>>>, "
    "candidates array<struct<finishReason:string,content:struct<parts:array<struct<text:string,thought:boolean>>>>>"
)
ITEM = "struct<text:string,sources:array<string>>"
SUMMARY_SCHEMA = f"overview {ITEM}, points array<{ITEM}>, facts array<{ITEM}>, uncertainties string"
VISUAL_SCHEMA = "notes array<struct<frame_id:string,title:string,visual_evidence:string>>"


def reply_decode(replies: DataFrame, *, vision: bool = False) -> DataFrame:
    """(provider, raw) → answer text or a reject reason.

    A text reply must have ended normally; a vision reply is taken as it is.
    """
    provider = F.col("provider")

    def judged(reply: Column) -> Column:
        choice, candidate = F.get(reply["choices"], F.lit(0)), F.get(reply["candidates"], F.lit(0))
        spoken = F.array_join(
            F.transform(
                F.filter(candidate["content"]["parts"], lambda p: ~F.coalesce(p["thought"], F.lit(False))),
                lambda p: F.coalesce(p["text"], F.lit("")),
            ),
            "",
        )
        answer = (
            F.when(provider == "ollama", reply["message"]["content"])
            .when(provider == "openai", choice["message"]["content"])
            .when(provider == "gemini", spoken)
        )
        ended = F.lit(True) if vision else (
            F.when(provider == "ollama", F.coalesce(reply["done_reason"], F.lit("")) != "length")
            .when(provider == "openai", (F.coalesce(choice["finish_reason"], F.lit("")) == "stop")
                  & (F.coalesce(choice["message"]["refusal"], F.lit("")) == ""))
            .otherwise(F.coalesce(candidate["finishReason"], F.lit("")) == "STOP")
        )
        return let(
            F.struct(answer.alias("answer"), F.when(~ended, "not finished").when(answer.isNull(), "no answer").alias("reason")),
            lambda r: F.struct(r["reason"].alias("reject_reason"), F.when(r["reason"].isNull(), r["answer"]).alias("answer")),
        )

    kept = [c for c in replies.columns if c not in ("reject_reason", "answer")]
    return replies.select(*kept, let(typed_json(F.col("raw"), ENVELOPE_SCHEMA), judged).alias("_r")).select(*kept, "_r.*")


def _bad_item(item: Column, allowed: Column) -> Column:
    size = F.length(strip(item["text"]))
    text = F.coalesce(~size.between(1, 1200), F.lit(True))
    refs = item["sources"]
    unknown = F.coalesce((F.size(refs) < 1) | (F.size(F.array_except(refs, allowed)) > 0), F.lit(True))
    return F.when(text, "bad text").when(unknown, "unknown source")


def summary_reply_check(replies: DataFrame) -> DataFrame:
    """(answer JSON, allowed ids) → first broken rule of a chunk summary, if any."""
    def judged(a: Column, allowed: Column) -> Column:
        items = F.concat(F.array(a["overview"]), a["points"], a["facts"])
        shape = a.isNull() | a["points"].isNull() | a["facts"].isNull() | a["uncertainties"].isNull()
        return let(
            F.array_compact(F.transform(items, lambda i: _bad_item(i, allowed))),
            lambda reasons: F.when(F.coalesce(shape, F.lit(True)), "bad shape")
            .when(F.size(reasons) > 0, F.get(reasons, F.lit(0)))
            .when(~F.size(a["points"]).between(1, 6) | (F.size(a["facts"]) > 4), "bad item count"),
        )

    parsed = typed_json(F.col("answer"), SUMMARY_SCHEMA)
    return replies.withColumn("reject_reason", let(parsed, lambda a: let(F.col("allowed"), lambda allowed: judged(a, allowed))))


def _rendered(item: Column) -> Column:
    marks = F.transform(item["sources"], lambda r: F.concat(F.lit("["), r, F.lit("]")))
    return F.concat(strip(item["text"]), F.lit(" "), F.array_join(marks, " "))


def summary_render(replies: DataFrame) -> DataFrame:
    """Accepted chunk summaries as text, with source marks after every statement."""
    bullets = lambda items: F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), _rendered(i))), "\n")

    def draft(a: Column) -> Column:
        return F.concat(
            F.lit("## 一句話摘要\n\n"), _rendered(a["overview"]),
            F.lit("\n\n## 重點\n\n"), bullets(a["points"]),
            F.lit("\n\n## 重要數字／日期／條件\n\n"),
            F.when(F.size(a["facts"]) > 0, bullets(a["facts"])).otherwise("未提供"),
            F.lit("\n\n## 待確認事項\n\n"), a["uncertainties"],
        )

    return replies.withColumn("draft", let(typed_json(F.col("answer"), SUMMARY_SCHEMA), draft))


def cited_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.CITED_ID), F.lit(1))


def citation_check(drafts: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, draft) against (doc_id, unit_id): cited and unknown ids, and the flag."""
    cited = drafts.select("doc_id", F.explode_outer(F.array_distinct(cited_ids(F.col("draft")))).alias("unit_id"))
    known = units.select("doc_id", "unit_id", F.lit(True).alias("known"))
    return (
        cited.join(known, ["doc_id", "unit_id"], "left")
        .groupBy("doc_id")
        .agg(
            F.count("unit_id").alias("cited"),
            F.count_if(F.col("unit_id").isNotNull() & F.col("known").isNull()).alias("unknown"),
        )
        .withColumn("flagged", (F.col("cited") == 0) | (F.col("unknown") > 0))
    )


def citation_link(drafts: DataFrame, units: DataFrame) -> DataFrame:
    """Every ``[S001]`` whose unit has a web address becomes a link to it."""
    cited = drafts.select("doc_id", F.explode(F.array_distinct(cited_ids(F.col("draft")))).alias("unit_id"))
    links = (
        cited.join(units.select("doc_id", "unit_id", "url"), ["doc_id", "unit_id"])
        .filter(F.col("url").rlike(r"\Ahttps?://"))
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "url"))).alias("links"))
    )

    def relink(part: Column) -> Column:
        ref = F.regexp_extract(part, r"(?U)\A\[(S\d+)\]", 1)
        url = F.try_element_at(F.col("links"), ref)
        return F.when(
            url.isNotNull(),
            F.concat(F.lit("["), ref, F.lit("]("), url, F.lit(")"), F.substring(part, F.length(ref) + 3, F.length(part))),
        ).otherwise(part)

    parts = F.split("draft", r"(?U)(?=\[S\d+\])")
    return drafts.join(links, "doc_id", "left").withColumn(
        "linked", F.array_join(F.transform(parts, relink), "")
    ).drop("links")


def visual_note_check(replies: DataFrame) -> DataFrame:
    """(frame_id, answer JSON) → first broken rule of a frame note, if any."""
    rows = replies.withColumn("_n", typed_json(F.col("answer"), VISUAL_SCHEMA)["notes"])
    note = F.get("_n", F.lit(0))
    sized = lambda c, low, high: F.coalesce(F.length(strip(c)).between(low, high), F.lit(False))
    reason = (
        F.when(F.col("_n").isNull() | (F.size("_n") > 1), "bad shape")
        .when(F.size("_n") == 0, None)
        .when(~F.coalesce(note["frame_id"] == F.col("frame_id"), F.lit(False)), "other frame")
        .when(~sized(note["title"], 2, 80), "bad title")
        .when(~sized(note["visual_evidence"], 5, 400), "bad description")
    )
    return rows.withColumn("reject_reason", reason).withColumn(
        "has_note", F.col("reject_reason").isNull() & (F.size("_n") == 1)
    ).drop("_n")
