"""Extractive summaries: document-frequency scoring, fact clues, budgets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.counts import document_frequencies, with_best_units
from ..functions.fold import let, pack_starts, take_while_fits
from .segment import explode_units, source_units, tokens_of, with_units


def token_df(units: DataFrame, scope: str = "doc_id") -> DataFrame:
    """Units of a scope of any size that contain each token; partial counts are made map-side."""
    return (
        units.select(scope, F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token"))
        .groupBy(scope, "token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def cue(text: Column) -> Column:
    return F.when(text.rlike(P.CUE), 1.0).otherwise(0.0)


def unit_scores(units: DataFrame, scope: str, unit: str) -> DataFrame:
    """(scope, unit, score) when a scope may be huge: equi-join on (scope, token).

    The frequency side has one row per key, so a token that fills a hot scope only
    makes a skewed stream side, which adaptive execution splits. What a text has is found
    before its tokens become rows: beside the explode it would be found again for each token.
    """
    found = units.select(scope, unit, tokens_of(F.col("text")).alias("_tokens"), cue(F.col("text")).alias("cue"))
    counted = found.withColumn("n_tokens", F.size("_tokens"))
    tokens = counted.select(scope, unit, "n_tokens", F.explode_outer(F.array_distinct("_tokens")).alias("token"), "cue")
    return (
        tokens.join(token_df(units, scope), [scope, "token"], "left")
        .groupBy(scope, unit)
        .agg(
            (
                F.coalesce(F.sum("df"), F.lit(0)) / F.greatest(F.max("n_tokens"), F.lit(1)) + F.max("cue")
            ).alias("score")
        )
    )


def document_df(docs: DataFrame, **options) -> DataFrame:
    """``token_df`` of whole documents, counted in their rows: (doc_id, token, df)."""
    return document_frequencies(with_units(docs, **options))


def with_picks(docs: DataFrame, *, top: int = P.KEY_SENTENCES, **options) -> DataFrame:
    """(doc_id, units, picks): the ``top`` best-scored units as (unit_no, score, rank), ties to
    the earlier, counted in the document's row."""
    units = with_units(docs, **options).select("doc_id", "units")
    return with_best_units(units.withColumn("cues", F.transform("units", lambda u: cue(u["text"]))), top)


def key_sentences(docs: DataFrame, *, top: int = P.KEY_SENTENCES, **options) -> DataFrame:
    """The ``top`` best-scored units of each document, with their scores."""
    return (
        with_picks(docs, top=top, **options)
        .select("doc_id", "units", F.explode_outer("picks").alias("p"))
        .filter(F.col("p").isNotNull())
        .select("doc_id", "p.*", F.element_at("units", F.col("p.unit_no")).alias("u"))
        .select("doc_id", "unit_no", F.col("u.unit_id").alias("unit_id"), "rank", "score",
                F.col("u.text").alias("text"), F.col("u.url").alias("url"))
    )


def facts_array(units: Column, limit: int = P.FACT_CLUES) -> Column:
    return F.slice(F.filter(units, lambda u: u["text"].rlike(P.FACT)), 1, limit)


def fact_clues(docs: DataFrame, *, limit: int = P.FACT_CLUES, **options) -> DataFrame:
    """The first ``limit`` units of each document that look like a fact."""
    found = with_units(docs, **options).select("doc_id", facts_array(F.col("units"), limit).alias("units"))
    return explode_units(found)


def _bullets(units: Column) -> Column:
    return F.array_join(
        F.transform(units, lambda u: F.concat(F.lit("- ["), u["unit_id"], F.lit("] "), u["text"])), "\n"
    )


def summary_text(keys: Column, facts: Column) -> Column:
    head = F.coalesce(F.nullif(_bullets(keys), F.lit("")), F.lit(P.SUMMARY_EMPTY))
    tail = let(
        _bullets(facts),
        lambda lines: F.when(lines != "", F.concat(F.lit("\n\n" + P.FACTS_HEAD + "\n\n"), lines)).otherwise(""),
    )
    return F.concat(F.lit(P.SUMMARY_HEAD + "\n\n"), head, tail)


def sources_text(units: Column) -> Column:
    return F.concat(
        F.lit(P.SOURCES_HEAD + "\n\n"),
        F.array_join(
            F.transform(
                units,
                lambda u: F.concat(
                    F.lit("### ["), u["unit_id"], F.lit("]\n\n"), u["text"],
                    F.lit("\n\n" + P.SOURCE_PREFIX), u["url"],
                ),
            ),
            "\n\n",
        ),
    )


def extractive_summary(docs: DataFrame, **options) -> DataFrame:
    """One report per document: key sentences in source order, fact clues, sources."""
    keys = F.transform("picks", lambda p: F.element_at(F.col("units"), p["unit_no"]))
    return with_picks(docs, **options).select(
        "doc_id",
        F.size("units").alias("n_units"),
        summary_text(keys, facts_array(F.col("units"))).alias("summary"),
        sources_text(F.col("units")).alias("sources"),
    )


def scope_extracts(units: DataFrame, scope: str, *, top: int = P.KEY_SENTENCES, limit: int = P.FACT_CLUES) -> DataFrame:
    """(scope, summary): the extract of units in rows (scope, unit_no, unit_id, text), for scopes
    of any size; a scope gathers no more than its ``top`` sentences and ``limit`` clues."""
    texts = units.select(scope, "unit_no", "unit_id", "text")
    best = W.partitionBy(scope).orderBy(F.desc("score"), "unit_no")
    ranked = unit_scores(texts, scope, "unit_no").withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top)
    keys = texts.join(ranked.select(scope, "unit_no"), [scope, "unit_no"]).withColumn("_kind", F.lit("key"))
    first = W.partitionBy(scope).orderBy("unit_no")
    clues = texts.filter(F.col("text").rlike(P.FACT)).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit)
    chosen = keys.unionByName(clues.drop("_n").withColumn("_kind", F.lit("clue")))
    listed = lambda kind: F.array_compact(F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.struct("unit_no", "unit_id", "text")))))
    return chosen.groupBy(scope).agg(listed("key").alias("_keys"), listed("clue").alias("_clues")).select(
        scope, summary_text(F.col("_keys"), F.col("_clues")).alias("summary"))


def _labelled_size(u: Column) -> Column:
    return F.length(u["unit_id"]) + F.length(u["text"]) + 3


def with_budget(df: DataFrame, *, budget: int = P.MODEL_BUDGET) -> DataFrame:
    """Cut ``units`` to the prefix that fits; ``truncated`` tells whether any is left out."""
    kept = [c for c in df.columns if c != "units"]
    cut = df.select(
        *kept,
        let(
            F.col("units"),
            lambda units: let(
                take_while_fits(units, _labelled_size, budget),
                lambda n: F.struct(
                    (n < F.size(units)).alias("truncated"), F.slice(units, F.lit(1), n).alias("units")
                ),
            ),
        ).alias("_cut"),
    )
    return cut.select(*kept, "_cut.*")


def char_budget(docs: DataFrame, *, budget: int = P.MODEL_BUDGET, max_chars: int | None = None,
                **options) -> DataFrame:
    """Units a model may see, with both truncation flags, one row per kept unit."""
    flagged = docs.withColumn("source_truncated", F.lit(False) if max_chars is None else F.length("text") > max_chars)
    cut = with_budget(with_units(flagged, max_chars=max_chars, **options), budget=budget)
    return explode_units(cut.select("doc_id", "truncated", "source_truncated", "units")).drop("url")


def cut_into_chunks(df: DataFrame, starts: Callable[[Column], Column]) -> DataFrame:
    """Explode ``units`` into (chunk_no, units); ``starts`` gives 1-based first positions."""
    kept = [c for c in df.columns if c != "units"]
    chunks = let(
        F.col("units"),
        lambda units: let(
            starts(units),
            lambda cuts: F.transform(
                cuts,
                lambda at, i: F.slice(
                    units, at, F.coalesce(F.get(cuts, i + 1), F.size(units) + 1) - at
                ),
            ),
        ),
    )
    return (
        df.select(*kept, F.posexplode_outer(chunks).alias("_c", "units"))
        .filter(F.col("units").isNotNull())
        .select(*kept, (F.col("_c") + 1).alias("chunk_no"), "units")
    )


def chunk_pack(docs: DataFrame, *, budget: int = P.MODEL_BUDGET, chunk_chars: int = P.CHUNK_CHARS,
               **options) -> DataFrame:
    """Budgeted units packed in order into chunks, one row per chunk with its text."""
    cut = with_budget(with_units(docs, **options).select("doc_id", "units"), budget=budget)
    return cut_into_chunks(
        cut.drop("truncated"),
        lambda units: pack_starts(units, _labelled_size, lambda u: F.lit(0.0), chunk_chars, None),
    ).select(
        "doc_id",
        "chunk_no",
        F.size("units").alias("n_units"),
        F.element_at("units", 1)["unit_id"].alias("first_unit"),
        F.array_join(
            F.transform("units", lambda u: F.concat(F.lit("["), u["unit_id"], F.lit("] "), u["text"])), "\n"
        ).alias("chunk"),
    )


__all__ = [
    "char_budget", "chunk_pack", "document_df", "extractive_summary", "fact_clues", "key_sentences",
    "source_units", "token_df", "unit_scores",
]
