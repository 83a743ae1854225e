"""Comparison of sources: balanced excerpts, group summaries, answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fold import let
from ..functions.text import is_blank, numbered, strip
from ..functions.typed_json import typed_json
from ..session import written
from .extract import unit_scores
from .prefix import running
from .segment import with_units

SECTIONS = tuple(P.COMPARE_SECTIONS)
ANSWER_SCHEMA = ", ".join(f"{s} array<struct<text:string,sources:array<string>>>" for s in SECTIONS)


def group_plan(docs: DataFrame, *, group: str = "source") -> DataFrame:
    """(doc_id, group, document, n_docs): numbers 1..n of the usable documents of a group.

    Only ids travel: the texts stay where they are until the plan is joined by doc_id.
    """
    usable = docs.filter(F.col("success") & ~is_blank(F.col("markdown"))).select(group, "doc_id")
    sizes = usable.groupBy(group).agg(F.count(F.lit(1)).alias("n_docs"))
    return running(usable, [group], "doc_id", number="document").join(sizes, group)


def _excerpt(units: Column, allowance: Column) -> Column:
    """Texts of the leading units, the last one cut to what is left of the allowance."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, unit: Column) -> Column:
        left = allowance - acc["used"]
        part = F.substring(unit["text"], F.lit(1), left.cast("int"))
        return F.when(left <= 0, acc).otherwise(
            F.struct((acc["used"] + F.length(part)).alias("used"), F.array_append(acc["parts"], part).alias("parts"))
        )

    return F.aggregate(units, state, step, lambda acc: acc["parts"])


def balanced_excerpts(docs: DataFrame, *, group: str = "source", budget: int = P.COMPARE_BUDGET,
                      minimum: int = P.COMPARE_MINIMUM) -> DataFrame:
    """(group, document, unit_id, doc_id, url, text): equal room for every usable document
    of a group of two or more."""
    share = F.greatest(F.lit(minimum), F.floor(F.lit(budget) / F.col("n_docs"))).cast("long")
    plan = group_plan(docs, group=group).filter(F.col("n_docs") >= 2).select(
        "doc_id", "document", share.alias("_share")
    )
    texts = docs.select("doc_id", group, "title", F.col("url").alias("page_url"), "url", F.col("markdown").alias("text"))
    parts = with_units(texts.join(plan, "doc_id")).withColumn(
        "_parts", _excerpt(F.col("units"), F.col("_share"))
    )
    return parts.filter(F.size("_parts") > 0).select(
        group, "document", numbered("S", F.col("document")).alias("unit_id"), "doc_id",
        F.col("page_url").alias("url"),
        F.concat(
            F.format_string(P.DOCUMENT_LEAD, F.col("document"), F.col("title")), F.array_join("_parts", "\n")
        ).alias("text"),
    )


def cross_source_summary(docs: DataFrame, *, group: str = "source") -> DataFrame:
    """Group reports as rows (group, section, n, line): key, fact, failed and source lines.

    The excerpts are read several times and are small next to the texts they are cut
    from, so they are written out once.
    """
    units = written(balanced_excerpts(docs, group=group), "excerpts")
    bullet = F.concat(F.lit("- ["), F.col("unit_id"), F.lit("] "), F.col("text"))
    best = W.partitionBy(group).orderBy(F.desc("score"), "document")
    top = (
        unit_scores(units, group, "document")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= P.KEY_SENTENCES)
        .select(group, "document")
    )
    line = lambda df, section, n, text: df.select(
        group, F.lit(section).alias("section"), F.col(n).cast("long").alias("n"), text.alias("line")
    )
    first = W.partitionBy(group).orderBy("document")
    facts = (
        units.filter(F.col("text").rlike(P.FACT))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= P.FACT_CLUES)
    )
    plan = group_plan(docs, group=group).filter(F.col("n_docs") >= 2).select("doc_id", "document")
    sources = docs.select("doc_id", group, "title", "url").join(plan, "doc_id")
    compared = sources.select(group).distinct()
    return (
        line(units.join(top, [group, "document"], "left_semi"), "key", "document", bullet)
        .unionByName(line(facts, "fact", "document", bullet))
        .unionByName(line(docs.filter(~F.col("success")).join(compared, group, "left_semi"), "failed", "doc_id", F.col("url")))
        .unionByName(line(sources, "source", "document", F.concat(
            F.col("document").cast("string"), F.lit(". "), F.col("title"), F.lit(" — "), F.col("url"))))
    )


def _cited(answers: DataFrame, keys: list[str], group: str, units: DataFrame) -> DataFrame:
    """One row per (answer, section, item, reference) with the unit it names, if any."""
    items = answers.select(
        *keys, group,
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("section"), F.col(s).alias("items")) for i, s in enumerate(SECTIONS)
        ])).alias("s"),
    ).select(*keys, group, "s.section", F.posexplode_outer("s.items").alias("item", "claim"))
    refs = items.select(
        *keys, group, "section", "item", F.col("claim.text").alias("text"),
        F.posexplode_outer("claim.sources").alias("ref_no", "ref"),
    )
    known = units.select(group, F.col("unit_id").alias("ref"), "document", "url")
    return refs.join(known, [group, "ref"], "left")


def comparison_validate(answers: DataFrame, units: DataFrame, *, group: str = "source") -> DataFrame:
    """(answer_id, group, answer JSON) → accepted, and the first broken rule.

    One bad item rejects the whole answer.
    """
    def judged(answer: Column) -> Column:
        shape = F.coalesce(*[
            F.when(answer[s].isNull() | (F.size(answer[s]) > 5), F.struct(
                F.lit(i).alias("section"), F.lit(-1).alias("item"), F.lit("bad section").alias("rule")))
            for i, s in enumerate(SECTIONS)
        ], F.when(answer.isNull(), F.struct(F.lit(0).alias("section"), F.lit(-1).alias("item"), F.lit("bad section").alias("rule"))))
        return F.struct(shape.alias("_shape"), *[F.when(F.size(answer[s]) <= 5, answer[s]).alias(s) for s in SECTIONS])

    # Every answer has a row of each section, which carries the answer's shape along.
    listed = answers.select("answer_id", group, let(typed_json(F.col("answer"), ANSWER_SCHEMA), judged).alias("a")).select("answer_id", group, "a.*")
    items = (
        _cited(listed, ["answer_id", "_shape"], group, units)
        .groupBy("answer_id", group, "_shape", "section", "item")
        .agg(
            F.max("text").alias("text"),
            F.count("ref").alias("refs"),
            F.count_if(F.col("document").isNull()).alias("unknown"),
            F.count_distinct("document").alias("documents"),
        )
    )
    rule = (
        F.when(F.col("item").isNull(), None)
        .when(F.col("text").isNull() | (F.length(strip(F.col("text"))) < 8) | (F.length("text") > 400), "bad text")
        .when((F.col("refs") == 0) | (F.col("unknown") > 0), "unknown source")
        .when((F.col("section") < 2) & (F.col("documents") < 2), "needs two documents")
    )
    broken = F.when(F.col("rule").isNotNull(), F.struct("section", "item", "rule"))
    first = F.array_min(F.array_compact(F.array("_shape", "_broken")))
    return (
        items.withColumn("rule", rule)
        .groupBy("answer_id", group, "_shape")
        .agg(F.min(broken).alias("_broken"))
        .select("answer_id", group, first.isNull().alias("accepted"), first["rule"].alias("rule"))
    )


def comparison_render(answers: DataFrame, units: DataFrame, *, group: str = "source") -> DataFrame:
    """Accepted answers as report text: three sections, each claim with its source links."""
    good = comparison_validate(answers, units, group=group).filter("accepted").select("answer_id")
    parsed = (
        answers.join(good, "answer_id", "left_semi")
        .select("answer_id", group, typed_json(F.col("answer"), ANSWER_SCHEMA).alias("a"))
        .select("answer_id", group, *[F.col(f"a.{s}").alias(s) for s in SECTIONS])
    )
    link = F.concat(F.lit("["), F.col("ref"), F.lit("]("), F.col("url"), F.lit(")"))
    claims = (
        _cited(parsed, ["answer_id"], group, units)
        .groupBy("answer_id", "section", "item", "text")
        .agg(F.sort_array(F.collect_list(F.struct("ref_no", link.alias("link")))).alias("links"))
        .withColumn("line", F.concat(
            F.lit("- "), F.col("text"), F.lit(" "), F.array_join(F.transform("links", lambda x: x["link"]), " ")))
    )
    sections = claims.groupBy("answer_id", "section").agg(
        F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "line")))).alias("lines")
    )
    heading = F.element_at(F.array(*[F.lit(h) for h in P.COMPARE_SECTIONS.values()]), F.col("section") + 1)
    body = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).otherwise(
        P.COMPARE_EMPTY
    )
    whole = sections.withColumn("part", F.concat(F.lit("## "), heading, F.lit("\n\n"), body)).groupBy("answer_id").agg(
        F.sort_array(F.collect_list(F.struct("section", "part"))).alias("parts")
    )
    return whole.select("answer_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("report"))
