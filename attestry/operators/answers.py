"""One answer per document from the replies of its chunks and a reply that merges them.

The lineage of an answer: a document's units are packed into chunks, every chunk has one
reply, which may cite what its chunk holds; a document of several chunks has one more reply
over their drafts, which may cite what the drafts cite. A document whose replies are not all
accepted has its own extract instead, with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import written
from .replies import citation_check, citation_link, cited_ids, summary_render, summary_reply_check


def chunk_drafts(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, drafts, cited, reason): the accepted drafts of every document in chunk
    order and the ids they cite. Chunks (doc_id, chunk_no, chunk) without a reply (doc_id,
    chunk_no, answer), or with one that breaks a rule, give the document a ``reason``."""
    held = chunks.select("doc_id", "chunk_no", F.array_distinct(cited_ids(F.col("chunk"))).alias("allowed"))
    rows = held.join(replies.select("doc_id", "chunk_no", "answer"), ["doc_id", "chunk_no"], "left")
    judged = summary_render(summary_reply_check(rows))
    bad = F.when(F.col("answer").isNull(), "no reply").otherwise(F.col("reject_reason"))
    # A document has as many chunks as the model's budget takes, so its drafts are few.
    drafts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "draft"))), lambda d: d["draft"])
    found = judged.withColumn("_bad", bad).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), drafts.alias("drafts"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("chunk_no"))).alias("reason"))
    return found.select("doc_id", "n_chunks", "drafts", F.array_distinct(cited_ids(F.array_join("drafts", "\n"))).alias("cited"), "reason")


def merged_answers(chunks: DataFrame, replies: DataFrame, merged: DataFrame, units: DataFrame, extracts: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, mode, reason, flagged, answer) of every document in ``extracts``
    (doc_id, summary).

    ``merged`` (doc_id, answer) are the replies over drafts. An answer that cites no unit of
    (doc_id, unit_id, url), or an unknown one, is flagged; citations become links; the drafts
    of several chunks follow the answer under their own headings.
    """
    drafts = chunk_drafts(chunks, replies)
    asked = drafts.join(merged.select("doc_id", F.col("answer")), "doc_id", "left").withColumn("allowed", F.col("cited"))
    judged = summary_render(summary_reply_check(asked))
    single = F.col("n_chunks") == 1
    reason = (
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("chunk: "), F.col("reason")))
        .when(single, None)
        .when(F.col("answer").isNull(), "merge: no reply")
        .when(F.col("reject_reason").isNotNull(), F.concat(F.lit("merge: "), F.col("reject_reason")))
    )
    parts = F.transform("drafts", lambda d, i: F.concat(F.format_string(P.PART_HEAD, i + 1), F.lit("\n\n"), d))
    tail = F.when(single, "").otherwise(F.concat(F.lit("\n\n" + P.PARTS_HEAD + "\n\n"), F.array_join(parts, "\n\n")))
    answers = written(judged.select(
        "doc_id", "n_chunks", reason.alias("reason"), F.when(single, F.get("drafts", F.lit(0))).otherwise(F.col("draft")).alias("_own"), tail.alias("_tail"),
    ), "answers")
    good = answers.filter("reason is null")
    flags = citation_check(good.select("doc_id", F.col("_own").alias("draft")), units).select("doc_id", "flagged")
    linked = citation_link(good.select("doc_id", F.concat("_own", "_tail").alias("draft")), units).select("doc_id", F.col("linked").alias("_linked"))
    whole = extracts.select("doc_id", "summary").join(answers.select("doc_id", "n_chunks", "reason"), "doc_id", "left")
    whole = whole.join(flags, "doc_id", "left").join(linked, "doc_id", "left")
    model = F.col("_linked").isNotNull()
    return whole.select(
        "doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(model, "model").otherwise("extract").alias("mode"),
        F.when(F.col("n_chunks").isNull(), "no units").otherwise(F.col("reason")).alias("reason"), "flagged",
        F.coalesce("_linked", "summary").alias("answer"))
