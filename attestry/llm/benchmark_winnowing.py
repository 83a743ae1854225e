"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts are hashed word by word into k-grams; of every ``window - k + 1`` consecutive
k-grams the smallest hash is kept. Whatever ``window`` words two texts share, they keep the
same fingerprint inside them, so joining fingerprints misses no shared window. A hit names
an item; it is extended to every whole window of the item in the document, by window hashes
and then word by word, each place of the document once. Items shorter than ``window`` words are one window each; they are found by
their own length's grams, for the lengths that occur.

The fingerprints of the benchmark are broadcast only if a count shows that they are few;
else the join is shuffled. The items that a document hits are gathered per document;
documents are hashed in one pass for all item lengths, and read again for the extension.

Defined results: null or wordless texts have no words and no hits; a null item_id or a
wordless item is left out; items with equal text all count; repeated rows have equal
results; a null doc_id is scanned like any other. Extra columns are ignored; an empty
benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of fingerprints (with their items' words) that may be broadcast.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Folded words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    """Hashes of every run of n words."""
    def of(w: Column) -> Column:
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) >= n, F.transform(
            F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>")))

    return let(words, of)


def winnowed(words: Column, k: int, window: int) -> Column:
    """The smallest k-gram hash of every ``window`` words, each once."""
    span = window - k + 1

    def of(g: Column) -> Column:
        return F.when(F.size(g) >= span, F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.size(g) - span), lambda i: F.array_min(F.slice(g, i + 1, span))))).otherwise(F.array().cast("array<bigint>"))

    return let(grams(words, k), of)


def fingerprints(benchmark: DataFrame, k: int, window: int) -> DataFrame:
    """(size, short, hash, item_id, words), one row for each item and hash: the kept grams of
    long items (size k), the whole of short ones."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    whole = F.size("words") < window
    kept = F.when(whole, F.array(_whole(F.col("words"), window))).otherwise(winnowed(F.col("words"), k, window))
    return items.select(F.when(whole, F.size("words")).otherwise(k).alias("size"), whole.alias("short"), F.explode(kept).alias("hash"), "item_id", "words")


def _whole(words: Column, window: int) -> Column:
    """The hash of all words of a short item, as ``grams`` of its length would give it."""
    sizes = [(n, grams(words, n)) for n in range(1, window)]
    out = F.lit(None).cast("bigint")
    for n, g in sizes:
        out = F.when(F.size(words) == n, F.get(g, F.lit(0))).otherwise(out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, k: int = 5, window: int = 13) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(docs, benchmark, k, window).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, k: int = 5, window: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    return _judged(docs, benchmark, k, window).filter("NOT contaminated").select("doc.*")


def _judged(docs: DataFrame, benchmark: DataFrame, k: int, window: int) -> DataFrame:
    prints = fingerprints(benchmark, k, window)
    # At most ``window`` sizes and one total reach the driver.
    sizes = prints.groupBy("size", "short").agg(F.sum(F.lit(64) + F.size("words") * 24).alias("bytes")).collect()
    few = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    if not sizes:
        return _verdict(keyed.select("doc", F.lit(None).cast(HITS).alias("hits")), window)

    def asked(words: Column) -> Column:
        """The document's hashes of every kind that the benchmark has."""
        def of_kind(size: int, short: bool) -> Column:
            found = F.array_distinct(grams(words, size)) if short else winnowed(words, k, window)
            return F.transform(found, lambda h: F.struct(F.lit(size).alias("size"), F.lit(short).alias("short"), h.alias("hash")))

        return F.concat(*(of_kind(r["size"], r["short"]) for r in sorted(sizes)))

    probes = keyed.select("doc_id", "h", F.explode(let(words_of(F.col("text")), asked)).alias("_p")).select("doc_id", "h", "_p.*")
    met = probes.join(F.broadcast(prints) if few else prints, ["size", "short", "hash"])
    hits = met.groupBy("doc_id", "h").agg(F.collect_set(F.struct("item_id", "words")).alias("hits"))
    left, right = keyed.drop("text").alias("d"), hits.alias("m")
    joined = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.h").eqNullSafe(F.col("m.h")), "left")
    return _verdict(joined.select("d.doc", "m.hits"), window)


HITS = "array<struct<item_id:bigint,words:array<string>>>"


def _verdict(rows: DataFrame, window: int) -> DataFrame:
    """Where whole windows of the items that were hit stand in each row, exactly.

    A document window is looked for among the item's windows by its hash, and compared word
    by word where that is found; however often words repeat, each place is looked at once.
    """
    nowhere = F.array().cast("array<int>")

    def of_long(w: Column, own: Column, item: Column) -> Column:
        """Starts in the document (its windows hashed: ``own``) of any window of a long item."""
        def among(theirs: Column) -> Column:
            same = lambda i: F.exists(F.sequence(F.lit(0), F.size(theirs) - 1), lambda j: (F.get(theirs, j) == F.get(own, i)) & (
                F.slice(w, i + 1, window) == F.slice(item["words"], j + 1, window)))
            return let(F.array_intersect(own, theirs), lambda common: F.when(F.size(common) > 0, F.filter(
                F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_contains(common, F.get(own, i)) & same(i))).otherwise(nowhere))

        return let(grams(item["words"], window), among)

    def of_short(w: Column, item: Column) -> Column:
        size, head = F.size(item["words"]), F.get(item["words"], F.lit(0))
        return F.when(F.size(w) >= size, F.filter(F.sequence(F.lit(0), F.size(w) - size), lambda i: (F.get(w, i) == head) & (
            F.slice(w, i + 1, size) == item["words"]))).otherwise(nowhere)

    def covered(w: Column, own: Column, item: Column) -> Column:
        """Document places inside any occurrence of a window of the item."""
        size = F.least(F.size(item["words"]), F.lit(window))
        starts = F.when(F.size(item["words"]) >= window, of_long(w, own, item)).otherwise(of_short(w, item))
        return F.struct(item["item_id"].alias("item_id"), F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + size - 1)))).alias("places"))

    def found(w: Column) -> Column:
        return let(grams(w, window), lambda own: let(
            F.transform("hits", lambda item: covered(w, own, item)), lambda each: F.filter(each, lambda c: F.size(c["places"]) > 0)))

    none = F.array().cast("array<struct<item_id:bigint,places:array<int>>>")
    row = let(words_of(F.col("doc.text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.when(F.col("hits").isNotNull() & (F.size(w) > 0), found(w)).otherwise(none).alias("found")))
    told = rows.select("doc", row.alias("r")).select(
        "doc", "r.n_words", F.size(F.array_distinct(F.flatten("r.found.places"))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("r.found.item_id", lambda x: x.cast("string")))).alias("items"))
    return told.select(
        "doc", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))
