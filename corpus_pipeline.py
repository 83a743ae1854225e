"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing to
target weights, token ids in training order.

Every stage is a function of (spark, docs, sf_dir); all but the last return rows with the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads
them again for the next one, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.benchmark_winnowing import decontaminated
from attestry.llm.mixing import mix_slots, mixed
from attestry.llm.ngram_jaccard import one_of_each
from attestry.llm.quality_rules import kept_rows
from attestry.llm.queries import MIX, MIX_BLOCK, table, vocabulary
from attestry.llm.training_order import materialise
from attestry.session import shared_folder

#: Sequences that are permuted together; each such range of the training order keeps the mix.
MIX_RANGE = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that sources interleave by their target weights."""
    return mixed(docs, MIX, block=MIX_BLOCK)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards in training order: sequences follow the mix, permuted within ranges.

    Rows of a table have no order, so the place of each document in the mix is derived again.
    """
    whole = docs.select("doc_id", "source", F.xxhash64("text").alias("text"), F.struct("text").alias("_doc"))
    placed = mix_slots(whole, MIX, block=MIX_BLOCK).select("doc_id", F.col("_doc.text").alias("text"), "_slot", "_in_block")
    return materialise(placed, vocabulary("byte_bpe_50k.tiktoken"), place=("_slot", "_in_block"), within=MIX_RANGE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Token ids cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return STAGES[-1][1](spark, rows, sf_dir)
