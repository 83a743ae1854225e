"""Ranked search against scoring every document, and the index against its postings."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from attestry.llm import lexical_search as lex
from attestry.session import written

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, k):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(term for _, tf, _ in docs for term in tf)
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scored = []
        for doc, tf, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, r in asked.items() if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def result(frame):
    return Counter(tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize(("k", "options"), [(20, {}), (3, {"shard_bytes": 4000, "query_block": 2}), (1, {"shard_bytes": 20_000})])
def test_search(spark, docs, rows, k, options):
    rng = random.Random(9)
    texts = [t for _, t, _ in rows if t and len(t) > 100]
    items = [(n, " ".join(rng.choice(texts).split()[:12] + rng.choice(texts).upper().split()[:8])) for n in range(12)]
    items += [(20, "A b, A b."), (21, None), (22, ""), (23, "nowhere zzzz"), (24, "one two THREE one"), (24, "one two THREE one"), (None, "one line z")]
    frame = spark.createDataFrame([(*x, "x", "x") for x in items], "item_id long, text string, shard string, term string")
    assert result(lex.ranked(docs, frame, k=k, **options)) == brute([(i, t) for i, t, _ in rows], items, k)


def test_search_with_shuffled_lists(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lex, "BROADCAST_TERMS", 0)
    items = [(1, rows[0][1]), (2, rows[30][1])]
    assert result(lex.ranked(docs, spark.createDataFrame(items, "item_id long, text string"), k=5)) == brute([(i, t) for i, t, _ in rows], items, 5)


def test_search_of_nothing(spark, nothing, docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lex.ranked(nothing, items).count() == 0
    assert lex.ranked(docs, items.limit(0)).count() == 0


def test_postings_round_trip_and_bounds(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", weights=[500, 80, 40, 20, 10, 5, 2, 1], k=rng.randint(1, 40))) for _ in range(1500)] + ["a " * 70_000]
    rows = [(n, t) for n, t in enumerate(texts)]
    index = written(lex.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), "test-index")
    found = {r.term: r for r in index.collect()}
    lengths = np.frombuffer(found[None].heads, "<u4").astype(np.int64)
    corpus = (found[None].n, found[None].total)
    assert lengths.tolist() == [len(t.split()) for t in texts] and corpus[1] == sum(map(len, map(str.split, texts)))
    for term in "abcdefgh":
        one = lex.PostingList(7, found[term].heads, found[term].data, corpus)
        docs, scores = one.whole(lengths)
        tf = [t.split().count(term) for t in texts]
        assert docs.tolist() == [n for n, c in enumerate(tf) if c] and found[term].n == len(docs)
        at, bound = one.blocks_of(docs)
        assert (scores <= bound).all() and one.bound == one.bounds.max()
        assert scores.tolist() == (7 * lex.impact(np.array([c for c in tf if c]), lengths[docs], *corpus)).tolist()


def test_blocks_are_rejected_without_unpacking(spark):
    rng = random.Random(4)
    rows = [(n, "common " * rng.randint(1, 3) + " ".join(f"w{rng.randrange(3000)}" for _ in range(20)) + (" rare" * 6 if n % 700 == 3 else "")) for n in range(6000)]
    index = written(lex.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), "test-index")
    found = {r.term: r for r in index.filter("term IS NULL OR term IN ('rare', 'common')").collect()}
    lengths, corpus = np.frombuffer(found[None].heads, "<u4").astype(np.int64), (found[None].n, found[None].total)
    weight = {"rare": 5000, "common": 3}
    lists = [(lex.PostingList(weight[t], found[t].heads, found[t].data, corpus), 1) for t in weight]
    docs, _ = lex.best_of_shard(lists, lengths, 5)
    assert all(d % 700 == 3 for d in docs.tolist()) and len(docs) == 5
    assert lists[0][0].ready.all() and lists[1][0].ready.sum() <= 9 < len(lists[1][0].ready)
