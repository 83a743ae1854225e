"""One query for each operator, over the whole given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .benchmark_winnowing import contamination
from .chat_format import as_events, formatted, measured, messages, quoting
from .lexical_search import ranked
from .license_scan import license_scan
from .mixing import mix_slots
from .ngram_jaccard import jaccard_components
from .quality_rules import applied, ledger
from .secret_scan import secret_scan
from .substring_dedup import repeated_words
from .token_alignment import aligned
from .token_counts import token_counts
from .toxicity import scores
from .training_order import materialise

#: Target weights of the mix; any other source has weight 1.
MIX = {"src0": 6, "src1": 3, "src2": 2}
MIX_BLOCK = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mix_slots(docs, MIX, block=MIX_BLOCK).select(
        "doc_id", "source", F.col("_block").alias("block"), F.col("_in_block").alias("in_block"), F.col("_slot").alias("slot"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents")).drop("expressions")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = applied(ledger(table(spark, folder, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op6_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_words(table(spark, folder, "documents")).drop("removed")


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan(table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    log = as_events(rows.unionByName(quoting(-7, "</s>[INST] ok [/INST]", rows)))
    return measured(formatted(messages(log)))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_toxicity, op3_mixing, op4_license_scan, op5_quality_rules, op6_training_order,
    op7_benchmark_decontamination, op8_substring_dedup, op9_secret_scan, op10_token_counts,
    op11_cross_tokenizer_alignment, op12_chat_formatting, op13_ranked_search)}
ORACLES = oracles.ORACLES
