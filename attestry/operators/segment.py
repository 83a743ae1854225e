"""Documents to numbered source units, without a shuffle.

All units of a document come from its one row, so the whole cut (lines, sentences,
keep-first, link unwrapping, 600-character pieces) is array expressions on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fold import let
from ..functions.text import lines_of, numbered


def _stamp(text: Column, other: Column) -> Column:
    """The caption link inside the text, else ``other``; the pattern runs only where one can be."""
    return F.when(
        text.contains(P.WATCH_PREFIX),
        F.coalesce(F.nullif(F.regexp_extract(text, P.STAMP_LINK, 0), F.lit("")), other),
    ).otherwise(other)


def _content_lines(body: Column) -> Column:
    """Lines that are more than one link."""
    return F.filter(
        lines_of(body),
        lambda line: ~(line.contains("](") & F.trim(line, F.lit(" -*#\t")).rlike(P.LINK_ONLY)),
    )


def _trimmed(part: Column) -> Column:
    return F.trim(part, F.lit(" #*\t\r"))


def _plain_sentences(body: Column, url: Column) -> Column:
    """Distinct sentences of a text without caption links: one split, one hash pass."""
    kept = F.when(body.contains("]("), F.array_join(_content_lines(body), "\n")).otherwise(body)
    parts = F.filter(F.transform(F.split(kept, P.ANY_BREAK), _trimmed), lambda s: F.length(s) >= 4)
    return F.transform(F.array_distinct(parts), lambda s: F.struct(s.alias("text"), url.alias("url")))


def _stamped_sentences(body: Column, url: Column) -> Column:
    """Distinct sentences of a text with caption links, which hold for their whole line."""

    def of_line(line: Column) -> Column:
        return let(
            _stamp(line, url),
            lambda inherited: F.transform(
                F.split(line, P.SENTENCE_BREAK),
                lambda s: F.struct(_trimmed(s).alias("text"), inherited.alias("url")),
            ),
        )

    sentences = F.filter(
        F.flatten(F.transform(_content_lines(body), of_line)), lambda s: F.length(s["text"]) >= 4
    )
    # Keep-first per text: sorting by (text, position) puts the first copy in front.
    by_text = F.sort_array(
        F.transform(
            sentences,
            lambda s, i: F.struct(s["text"].alias("text"), i.alias("i"), s["url"].alias("url")),
        )
    )
    firsts = let(
        by_text,
        lambda every: F.filter(
            every, lambda s, i: (i == 0) | (F.get(every, i - 1)["text"] != s["text"])
        ),
    )
    in_order = F.sort_array(
        F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["text"].alias("text"), s["url"].alias("url")))
    )
    return F.transform(in_order, lambda s: F.struct(s["text"].alias("text"), _stamp(s["text"], s["url"]).alias("url")))


def _unlinked(text: Column) -> Column:
    return F.when(text.contains("](http"), F.regexp_replace(text, P.HTTP_LINK, "$1")).otherwise(text)


def _pieces(item: Column, size: int) -> Column:
    return F.when(F.length(item["text"]) <= size, F.array(item)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.length(item["text"]) - 1, F.lit(size)),
            lambda at: F.struct(
                F.substring(item["text"], at + 1, F.lit(size)).alias("text"), item["url"].alias("url")
            ),
        )
    )


def with_units(docs: DataFrame, *, text: str = "text", url: str = "url",
               max_chars: int | None = None, piece_chars: int = P.PIECE_CHARS) -> DataFrame:
    """Replace ``text`` and ``url`` by ``units``: array of (unit_no, unit_id, text, url).

    Documents that were cut before, which have ``units`` and no text, stay as they are: where
    several steps need the units, cut once and write them.
    """
    if "units" in docs.columns and text not in docs.columns:
        return docs
    kept = [c for c in docs.columns if c not in (text, url)]
    whole, link = F.coalesce(F.col(text), F.lit("")), F.col(url)
    body = whole if max_chars is None else F.substring(whole, 1, max_chars)
    sentences = let(
        body,
        lambda b: F.when(b.contains(P.WATCH_PREFIX), _stamped_sentences(b, link)).otherwise(_plain_sentences(b, link)),
    )
    finished = F.filter(
        F.transform(sentences, lambda s: F.struct(_unlinked(s["text"]).alias("text"), s["url"].alias("url"))),
        lambda s: s["text"].rlike(P.LETTERS_4),
    )
    pieces = F.flatten(F.transform(finished, lambda s: _pieces(s, piece_chars)))
    units = F.transform(
        pieces,
        lambda u, i: F.struct(
            (i + 1).alias("unit_no"),
            numbered("S", i + 1).alias("unit_id"),
            u["text"].alias("text"),
            u["url"].alias("url"),
        ),
    )
    return docs.select(*kept, units.alias("units"))


def explode_units(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c != "units"]
    # An outer explode: the inner one makes the optimizer infer a size filter that
    # evaluates the whole cut a second time.
    return (
        df.select(*kept, F.explode_outer("units").alias("_u"))
        .filter(F.col("_u").isNotNull())
        .select(*kept, "_u.*")
    )


def source_units(docs: DataFrame, **options) -> DataFrame:
    """One row per unit: document columns + unit_no, unit_id, text, url."""
    return explode_units(with_units(docs, **options))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(P.TOKEN), F.lit(0))


def unit_tokens(units: DataFrame) -> DataFrame:
    """Units with all tokens and the distinct ones."""
    return units.withColumn("tokens", tokens_of(F.col("text"))).withColumn(
        "distinct_tokens", F.array_distinct("tokens")
    )
