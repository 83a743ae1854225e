"""Document frequencies within one row: an Arrow counter over the units of a document.

A row holds all units of its document, so which unit has which token is counted where the
row is; no token leaves its task and nothing is sorted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import patterns as P

PICKS = "array<struct<unit_no:int,score:double,rank:int>>"
PICK = pa.struct([("unit_no", pa.int32()), ("score", pa.float64()), ("rank", pa.int32())])


def tokens_by_unit(units: pa.ListArray) -> Iterator[list[list[str]]]:
    """Tokens of every unit of every row."""
    find = re.compile(P.TOKEN).findall
    texts = units.flatten().field("text").to_pylist()
    start = 0
    for size in units.value_lengths().fill_null(0).to_pylist():
        yield [find((text or "").lower()) for text in texts[start : start + size]]
        start += size


def frequencies(units: list[list[str]]) -> Counter[str]:
    """Units that contain each token."""
    df: Counter[str] = Counter()
    for tokens in units:
        df.update(set(tokens))
    return df


def best_units(units: list[list[str]], cues: list[float], top: int) -> list[dict[str, float]]:
    """The ``top`` best units in source order, ties to the earlier: a unit scores the
    frequencies of its distinct tokens over the number of its tokens, and its cue."""
    df = frequencies(units)
    scores = [sum(map(df.__getitem__, set(tokens))) / max(len(tokens), 1) + cue for tokens, cue in zip(units, cues, strict=True)]
    ranked = sorted(range(len(units)), key=lambda n: -scores[n])[:top]
    return [{"unit_no": n + 1, "score": scores[n], "rank": ranked.index(n) + 1} for n in sorted(ranked)]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, token, df) of rows (doc_id, units)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, tokens, sizes = [], [], []
            for row, units in enumerate(tokens_by_unit(batch["units"])):
                df = frequencies(units)
                places += [row] * len(df)
                tokens += df.keys()
                sizes += df.values()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(places, pa.int64())), pa.array(tokens, pa.string()), pa.array(sizes, pa.int64())],
                ["doc_id", "token", "df"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "units").mapInArrow(counted, f"doc_id {kind}, token string, df long")


def with_best_units(docs: DataFrame, top: int) -> DataFrame:
    """Rows (…, units, cues) with ``picks`` in place of ``cues``: the ``top`` best units."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, cues = tokens_by_unit(batch["units"]), batch["cues"].to_pylist()
            picks = [best_units(some, mine or [], top) for some, mine in zip(units, cues, strict=True)]
            kept = [n for n in batch.schema.names if n != "cues"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(picks, pa.list_(PICK))], [*kept, "picks"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "cues"]
    return docs.mapInArrow(picked, ", ".join([*kinds, f"picks {PICKS}"]))
