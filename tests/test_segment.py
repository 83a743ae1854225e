import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.operators import extract as X
from attestry.operators.segment import source_units

SCHEMA = "doc_id long, text string, url string"


def units(spark, *texts):
    df = spark.createDataFrame([(i, t, "https://example.com/d") for i, t in enumerate(texts)], SCHEMA)
    return [r.asDict() for r in source_units(df).orderBy("doc_id", "unit_no").collect()]


def test_caption_link_is_inherited_by_every_sentence_of_its_line(spark):
    line = "[00:01:05](https://www.youtube.com/watch?v=abcdefghijk&t=65s) First point here. Second point here."
    got = units(spark, line + "\nPlain line follows here.")
    assert [u["text"] for u in got] == ["00:01:05 First point here.", "Second point here.", "Plain line follows here."]
    assert got[0]["url"].endswith("&t=65s") and got[1]["url"].endswith("&t=65s")
    assert got[2]["url"] == "https://example.com/d"


def test_link_lines_duplicates_and_short_parts_are_left_out(spark):
    got = units(spark, "[nav](https://example.com/)\nSame line. Same line.\nab\n1234 5678\n# Heading text\nSame line.")
    assert [u["text"] for u in got] == ["Same line.", "Heading text"]
    assert [u["unit_id"] for u in got] == ["S001", "S002"]


def test_links_are_unwrapped_after_deduplication(spark):
    got = units(spark, "See [terms](https://example.com/a) now.\nSee [terms](https://example.com/b) now.")
    assert [u["text"] for u in got] == ["See terms now."] * 2


def test_cjk_sentences_split_without_white_space(spark):
    assert [u["text"] for u in units(spark, "今天天氣很好。明天會下雨！對嗎")] == ["今天天氣很好。", "明天會下雨！"]


def test_long_units_are_cut_and_ids_grow_past_999(spark):
    got = units(spark, "x" * 1300, "\n".join(f"line number {chr(97 + i % 26)} {i}" for i in range(1005)))
    assert [len(u["text"]) for u in got if u["doc_id"] == 0] == [600, 600, 100]
    assert [u["unit_id"] for u in got if u["doc_id"] == 1][-1] == "S1005"


def test_malformed_brackets_finish(spark):
    docs = spark.createDataFrame([(0, "[" * 500_000 + "text after the limit", "u")], "doc_id long, text string, url string")
    assert source_units(docs, max_chars=500_000).count() == 0
    assert source_units(docs).orderBy("unit_no").collect()[-1]["text"].endswith("text after the limit")


def test_accented_letters_do_not_count(spark):
    assert units(spark, "éèêë çàùï.") == []


LINE = st.text(alphabet="ab .!?。！\n\r\t\u3000\x85#*-é1[]()", max_size=60)


def plain(text):
    """Brute force over one text without links."""
    seen, out = set(), []
    for line in text.splitlines():
        if re.fullmatch(r"\[[^\]]+\]\([^)]+\)", line.strip(" -*#\t")):
            continue
        for part in re.split(r"(?<=[。！？])|(?<=[.!?])\s+", line):
            part = part.strip(" #*\t\r")
            if len(part) >= 4 and part not in seen:
                seen.add(part)
                if len(re.findall(r"[A-Za-z一-鿿]", part)) >= 4:
                    out += [part[i:i + 600] for i in range(0, len(part), 600)]
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINE, min_size=20, max_size=40))
def test_units_equal_brute_force(spark, texts):
    got = units(spark, *texts)
    for i, text in enumerate(texts):
        mine = [u["text"] for u in got if u["doc_id"] == i]
        assert mine == plain(text)
        assert [u["unit_no"] for u in got if u["doc_id"] == i] == list(range(1, len(mine) + 1))


def test_fact_clues_and_summary(spark):
    df = spark.createDataFrame([(1, "報名截止 2026-10-01 請注意。\n費用 300 元，不退款。", "u"), (2, "", "u")], SCHEMA)
    rows = {r["doc_id"]: r["summary"] for r in X.extractive_summary(df).collect()}
    assert "300 元" in rows[1] and "線索" in rows[1]
    assert rows[2].endswith("可用文字不足，無法產生可靠摘要。")
    assert X.fact_clues(df).count() == 2


def test_chunks_keep_the_limit_unless_a_single_unit(spark, sf):
    from attestry.plans.documents import chunk_pack

    wide = chunk_pack(spark, sf).filter((F.length("chunk") - F.col("n_units") + 1 > 4500) & (F.col("n_units") > 1))
    assert wide.count() == 0


def test_budget_stops_at_the_first_overflow(spark):
    text = "\n".join(["alpha beta gamma delta"] + ["word " * 20 + str(i) for i in range(5)] + ["tiny line"])
    df = spark.createDataFrame([(1, text, "u")], SCHEMA)
    kept = X.char_budget(df, budget=150).orderBy("unit_no").collect()
    sizes = [len(f"[{r['unit_id']}] {r['text']}") for r in kept]
    assert [r["unit_no"] for r in kept] == [1, 2] and sum(sizes) <= 150
    assert all(r["truncated"] for r in kept)


def test_documents_cut_before_give_the_same_rows(spark):
    from attestry.operators import extract as X
    from attestry.operators import segment as S

    docs = spark.createDataFrame(
        [(1, "First sentence of the text. Second one costs $5 today.\nThird line here.", "https://e.com/1"), (2, "", "https://e.com/2"), (3, None, None)],
        "doc_id long, text string, url string")
    cut = S.with_units(docs).select("doc_id", "units")
    for made in (S.source_units, X.chunk_pack, X.extractive_summary):
        want = made(docs.select("doc_id", "text", "url"))
        assert want.count() > 0 and sorted(map(str, made(cut).select(want.columns).collect())) == sorted(map(str, want.collect()))
