import random

import pytest
from pyspark.sql import types as T

#: Extra columns whose names clash with names used inside the operators.
CLASHING = ("packet", "bucket", "n", "hits", "doc", "h", "token", "_rank", "_slot", "kept", "failed", "cell", "_ledger")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in CLASHING)])
ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from high trees tonight"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    changed = base.split()
    rows = [(0, base, "src0"), (7, base, "src0"), (7, base, "src0"), (3, None, None), (4, "", "src1"), (5, " \t\n ", "src1"), (None, base, "src0"), (None, None, None)]
    for k in range(8, 20):
        edited = list(changed)
        for at in rng.sample(range(120), k - 7):
            edited[at] = rng.choice(words)
        rows.append((k, " ".join(edited), "src0" if k % 2 else None))
    passage = text(60)
    rows += [(k, f"{text(40)} {passage}\n{text(30)}", f"src{k % 4}") for k in range(20, 32)]
    rows += [(32, text(6000), "src2"), (33, f"{text(30)} {ITEM.upper()}! {text(10)}", "src2"), (34, "A b, A b. A B", "src2"), (35, "one two three", "src3"), (36, "One TWO three", "src3")]
    rows += [(37, "a b c d e f g h i j k l", "x"), (38, "a b c d e f g h i j k", "x"), (39, "a b c d e f g h i j", "x"), (40, f"{ITEM} {text(5)} {ITEM}", "x")]
    rows += [(41, "line\n" * 30, "x"), (42, "z " * 500, "x"), (43, "### $$$ word " * 10, "x")]
    rows += [(k, text(rng.randint(1, 300)), f"src{k % 3}") for k in range(44, 100)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *("x" for _ in CLASHING)) for i, t, s in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
