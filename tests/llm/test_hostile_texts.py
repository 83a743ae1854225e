"""Texts made to be slow: nested and repeated licence expressions, repeated words."""

import time

import pytest

from attestry.llm import license_scan as lic
from attestry.llm.benchmark_winnowing import contamination


def test_leaves_are_those_of_the_choices():
    for text in ("mit", "(mit or apache-2.0) and zlib", "gpl-2.0 with classpath-exception or mit and mit", "((a))", "a or b or a with c"):
        assert set(lic.leaves(text)) == {x for choice in lic.choices(text) for x in choice}
    for bad in ("", "mit or", "a with (b or c)", "a with b with c", "(a", "a b"):
        with pytest.raises(ValueError):
            lic.leaves(bad)


def test_expressions_of_many_clauses_and_many_tags():
    began = time.process_time()
    phrases, tags = lic.automata()
    clauses = " and ".join(f"(a{n} or b{n})" for n in range(2000))
    found = lic.scan(f"SPDX-License-Identifier: {clauses}", phrases, tags)
    assert len(found[5].split(",")) == 4000 and found[5].startswith("a0,a1,")
    for text in ("license-expression: x " * 50_000, "license-expression: (" * 50_000, "license-expression: x and (" * 50_000, "spdx-license-identifier: " + "(" * 1_000_000):
        lic.scan(text, phrases, tags)
    assert lic.scan("license-expression: x and license-expression: y", phrases, tags)[5] == "unparsed,y"
    assert time.process_time() - began < 20


def contaminated_words(text, items, window=13):
    words = text.split()
    hit, ids = set(), set()
    for item, other in items:
        theirs = other.split()
        size = min(window, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)}
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                ids.add(str(item))
    return len(words), len(hit), len(ids)


def test_contamination_of_repeated_words(spark):
    texts = ["again " * 5000, "a b " * 2500, "again " * 40 + "other words here " * 60, "one two three " * 4 + "again", "b a " * 300 + "again again", "again " * 12]
    items = [(1, "again " * 5000), (2, "a b " * 900), (3, "again again"), (4, "three one two"), (5, "x " + "again " * 13)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    rows = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items").collect()
    took = time.time() - began
    assert {r[0]: tuple(r)[1:] for r in rows} == {n: contaminated_words(t, items) for n, t in enumerate(texts)}
    assert took < 60
