"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document; the ledger stores the measurements and
one failure bit for each rule. Policies are versioned masks over the bits: applying one,
comparing two, or asking what a policy would keep without one of its rules is bitwise
arithmetic on the ledger and never reads a text again.

Defined results: a null or blank text has no words and fails ``few_words``. Rows are
independent. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_row, gram_hashes, plain_words, word_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
ARROW = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])

#: Rules in bit order; a true condition is a failure.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 15 * n_words",
    "many_words": "n_words > 100000",
}
BITS = {rule: 1 << k for k, rule in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "prose-1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_mean_word", "long_mean_word"),
}


def measure(text: str | None) -> tuple[int, ...]:
    words = plain_words(text)
    if not words:
        return 0, 0, sum(text.count(chr(c)) for c in SYMBOLS) if text else 0, 0, 0, 0
    chars = sum(map(len, map(bytes.decode, words))) if not text.isascii() else sum(map(len, words))
    lines = [line for line in text.split("\n") if line.strip(" \t\r\v\f")]
    grams = gram_hashes(word_hashes(words), REPEAT)
    repeated = 0
    if len(grams):
        order = np.argsort(grams, kind="stable")
        same = np.zeros(len(grams) + 1, bool)
        same[1:-1] = grams[order][1:] == grams[order][:-1]
        twice = order[same[1:] | same[:-1]]
        if len(twice):
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, twice, 1)
            np.add.at(step, twice + REPEAT, -1)
            repeated = int((np.cumsum(step[:-1]) > 0).sum())
    return len(words), chars, sum(text.count(chr(c)) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines)


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row of ``docs`` (doc_id, text)."""

    def run(rows):
        found = [measure(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {m: [f[k] for f in found] for k, m in enumerate(MEASURES)}

    return docs.select("doc_id", "text").mapInArrow(by_row(run, ARROW), SCHEMA)


def with_measurements(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the measurements of each row's text as struct column ``name``."""
    place = docs.columns.index("text")
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    def append(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [dict(zip(MEASURES, measure(t), strict=True)) for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, name])

    struct = ",".join(f"{m}:bigint" for m in MEASURES)
    return docs.mapInArrow(append, T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(f"struct<{struct}>"))]))


def kept_rows(docs: DataFrame, policy: str = "prose-1") -> DataFrame:
    """The rows of ``docs``, all columns, that the base and a policy keep."""
    name = "_ledger"
    while name in docs.columns:
        name += "_"
    return with_measurements(docs, name).filter(
        (_bits(f"{name}.").bitwiseAND(F.lit(mask(policy) | mask("base-1")))) == 0).drop(name)


def _bits(prefix: str = "") -> Column:
    """Failure bits of all rules over measurements, which may be fields of a struct."""
    bits = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        asked = re.sub("|".join(MEASURES), lambda m: prefix + m[0], condition)
        bits = bits.bitwiseOR(F.when(F.expr(asked), F.lit(BITS[rule]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``failed``, one bit for each rule of RULES."""
    return measurements(docs).withColumn("failed", _bits())


def mask(policy: str) -> int:
    return sum(BITS[rule] for rule in POLICIES[policy])


def rejects(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row fails a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) != 0


def applied(ledger_rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """The ledger with base_failed and the verdict of a policy, which never keeps what the base rejects."""
    return ledger_rows.withColumns({
        "base_failed": rejects("base-1"), "kept": ~(rejects("base-1") | rejects(policy)), "policy": F.lit(policy)})


def ablations(ledger_rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects (kept if it
    were left out), and rows the policy keeps. One pass over the bits, map-side combined."""
    whole = F.lit(mask(policy))
    own = F.col("failed").bitwiseAND(whole)
    counts = [F.sum((own == 0).cast("long")).alias("kept")]
    for rule in POLICIES[policy]:
        counts += [F.sum((own.bitwiseAND(F.lit(BITS[rule])) != 0).cast("long")).alias(f"{rule}_fails"),
                   F.sum((own == BITS[rule]).cast("long")).alias(f"{rule}_alone")]
    rows = F.array(*(F.struct(F.lit(rule).alias("rule"), F.coalesce(f"{rule}_fails", F.lit(0)).alias("fails"),
                              F.coalesce(f"{rule}_alone", F.lit(0)).alias("alone")) for rule in POLICIES[policy]))
    return ledger_rows.agg(*counts).select(F.explode(rows).alias("r"), F.coalesce("kept", F.lit(0)).alias("kept")).select("r.*", "kept")
