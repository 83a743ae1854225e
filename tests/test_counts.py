"""In-row counters against a plain count, and the plan they leave."""

import random
import re
from collections import Counter

from attestry.operators import extract as X
from attestry.operators import segment as S

SCHEMA = "doc_id long, text string, url string, packet string"


def corpus():
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "Delta", "ab", "重要", "截止日期", "éclair", "İstanbul", "x9y", "noted"]
    text = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30)))
    return [(n, text(), "u", "x") for n in range(40)] + [(40, None, None, None), (41, "", "u", "x"), (42, "abc. " * 3000, "u", "x"), (None, text(), "u", "x"), (1, text(), "u", "x")]


def expected(units, top):
    """Picks of one document from its units' texts."""
    tokens = [re.findall(r"[a-z]{3,}|[一-鿿]{2}", t.lower()) for t in units]
    df = Counter(x for some in tokens for x in set(some))
    cue = [1.0 if re.search(r"\d|重要|建議|注意|結論|截止|步驟", t) else 0.0 for t in units]
    scores = [sum(df[x] for x in set(some)) / max(1, len(some)) + c for some, c in zip(tokens, cue)]
    best = sorted(range(len(units)), key=lambda n: (-scores[n], n))[:top]
    return sorted((n + 1, scores[n], best.index(n) + 1) for n in best), df


def test_picks_and_frequencies(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    rows = X.with_picks(docs, top=4).collect()
    assert len(rows) == len(corpus())
    sizes = Counter()
    for r in rows:
        picks, df = expected([u["text"] for u in r["units"]], 4)
        assert [tuple(p) for p in r["picks"]] == picks
        sizes.update((r["doc_id"], token, n) for token, n in df.items())
    assert Counter(map(tuple, X.document_df(docs).collect())) == sizes
    by_scope = Counter(map(tuple, X.token_df(S.source_units(docs.filter("doc_id > 1"))).collect()))
    assert by_scope == Counter({k: v for k, v in sizes.items() if k[0] is not None and k[0] > 1})


def test_no_text_is_exchanged(spark):
    docs = spark.range(10).selectExpr("id as doc_id", "'some text here' as text", "'u' as url")
    for frame in (X.key_sentences(docs), X.document_df(docs), X.extractive_summary(docs)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.key_sentences(empty).count() == X.document_df(empty).count() == X.extractive_summary(empty).count() == 0
