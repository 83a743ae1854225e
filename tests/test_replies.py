import json

from pyspark.sql import functions as F

from attestry.functions.typed_json import typed_json
from attestry.operators import compare as C
from attestry.operators import notes as N
from attestry.operators import replies as R

UNIT = "struct<unit_no:int,unit_id:string,text:string,url:string,time:string,seconds:long>"


def chunk(spark, *texts):
    units = [(i + 1, f"S{i + 1:03d}", t, f"https://e.com/{i}", f"00:00:{i:02d}", i * 30) for i, t in enumerate(texts)]
    return spark.createDataFrame([(1, 1, units)], f"video_id long, chunk_no int, units array<{UNIT}>")


def reply(spark, notes, uncertainties="無"):
    return spark.createDataFrame([(1, 1, json.dumps({"notes": notes, "uncertainties": uncertainties}, ensure_ascii=False))],
                                 "video_id long, chunk_no int, answer string")


def note(**over):
    return {"title": "Ball control", "text": "The speaker explains how to keep the ball.", "sources": ["S001"],
            "evidence": "a quote from the text", **over}


def test_quote_may_span_units(spark):
    cut = chunk(spark, "Keep your eyes", "on the Ball at all times", "then pass")
    quotes = spark.createDataFrame(
        [(1, 1, 1, "eyes on the ball"), (1, 1, 2, "not there"), (1, 1, 3, ""), (1, 1, 4, "THEN PASS")],
        "video_id long, chunk_no int, note_no int, evidence string")
    got = {r["note_no"]: r["refs"] for r in N.quote_locate(quotes, cut).collect()}
    assert got == {1: ["S001", "S002"], 2: [], 3: [], 4: ["S003"]}


def test_one_good_note_is_kept_with_its_real_sources(spark):
    cut = chunk(spark, "Keep your eyes", "on the ball")
    got = N.note_validate(reply(spark, [note(evidence="eyes on the ball"), note(evidence="invented words")]), cut).first()
    assert got["reject_reason"] is None and got["dropped"] == 2
    assert [p["refs"] for p in got["points"]] == [["S001", "S002"]]


def test_a_title_is_needed_only_in_the_outline(spark):
    got = N.note_validate(reply(spark, [note(title="x", evidence="your eyes")]), chunk(spark, "Keep your eyes")).first()
    assert len(got["points"]) == 1 and got["outline"] == [] and got["dropped"] == 1


def test_vague_or_only_bad_notes_reject_the_reply(spark):
    cut = chunk(spark, "Keep your eyes")
    vague = note(text="影片主要介紹各種實用的技巧。", evidence="your eyes")
    assert N.note_validate(reply(spark, [vague]), cut).first()["reject_reason"] == "nothing verified"
    assert N.note_validate(reply(spark, []), cut).first()["reject_reason"] is None
    broken = spark.createDataFrame([(1, 1, "[]")], "video_id long, chunk_no int, answer string")
    assert N.note_validate(broken, cut).first()["reject_reason"] == "bad shape"


def test_an_unsupported_claim_becomes_its_quote(spark):
    checked = N.note_validate(reply(spark, [note(evidence="your eyes"), note(evidence="Keep your")]), chunk(spark, "Keep your eyes"))
    verdicts = spark.createDataFrame([(1, 1, 1, False), (1, 1, 2, True)], "video_id long, chunk_no int, n int, supported boolean")
    rows = {(r["section"], r["n"]): r for r in N.claim_gate(checked, verdicts).collect()}
    assert rows[("points", 1)]["title"] == "字幕原句" and rows[("points", 1)]["text"] == "字幕原句：「your eyes」"
    assert ("outline", 1) not in rows and ("outline", 2) in rows and not rows[("points", 2)]["failed"]
    missing = N.claim_gate(checked, verdicts.filter("n = 1"))
    assert missing.filter("failed").count() == missing.count() > 0


def test_summary_rules(spark):
    item = {"text": "ok", "sources": ["S001"]}
    answers = {
        "good": {"overview": item, "points": [item], "facts": [], "uncertainties": ""},
        "unknown": {"overview": item, "points": [{"text": "x", "sources": ["S999"]}], "facts": [], "uncertainties": ""},
        "no refs": {"overview": item, "points": [{"text": "x", "sources": []}], "facts": [], "uncertainties": ""},
        "blank": {"overview": {"text": " ", "sources": ["S001"]}, "points": [item], "facts": [], "uncertainties": ""},
        "many": {"overview": item, "points": [item] * 7, "facts": [], "uncertainties": ""},
        "shape": {"overview": item, "points": [item], "uncertainties": ""},
    }
    df = spark.createDataFrame([(k, json.dumps(v), ["S001"]) for k, v in answers.items()], "k string, answer string, allowed array<string>")
    assert {r["k"]: r["reject_reason"] for r in R.summary_reply_check(df).collect()} == {
        "good": None, "unknown": "unknown source", "no refs": "unknown source", "blank": "bad text",
        "many": "bad item count", "shape": "bad shape"}


def test_decoding(spark):
    rows = [
        ("ollama", {"message": {"content": "a"}}, "a", None), ("ollama", {"done_reason": "length", "message": {"content": "a"}}, None, "not finished"),
        ("openai", {"choices": [{"finish_reason": "stop", "message": {"content": "b", "refusal": "no"}}]}, None, "not finished"),
        ("openai", {"choices": []}, None, "not finished"),
        ("gemini", {"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "t", "thought": True}, {"text": "c"}, {"text": "d"}]}}]}, "cd", None),
        ("gemini", {"candidates": [{"finishReason": "SAFETY"}]}, None, "not finished"),
    ]
    df = spark.createDataFrame([(i, p, json.dumps(e)) for i, (p, e, _, _) in enumerate(rows)], "i long, provider string, raw string")
    got = {r["i"]: (r["answer"], r["reject_reason"]) for r in R.reply_decode(df).collect()}
    assert got == {i: (a, why) for i, (_, _, a, why) in enumerate(rows)}


def test_citations(spark):
    drafts = spark.createDataFrame([(1, "x [S001] y [S002]"), (2, "none"), (3, "[S009] z")], "doc_id long, draft string")
    units = spark.createDataFrame([(d, f"S00{i}", "https://e.com" if i == 1 else "file") for d in (1, 2, 3) for i in (1, 2)],
                                  "doc_id long, unit_id string, url string")
    assert {r["doc_id"]: r["flagged"] for r in R.citation_check(drafts, units).collect()} == {1: False, 2: True, 3: True}
    assert {r["doc_id"]: r["linked"] for r in R.citation_link(drafts, units).collect()} == {
        1: "x [S001](https://e.com) y [S002]", 2: "none", 3: "[S009] z"}


def test_comparison_needs_two_documents(spark):
    units = spark.createDataFrame([("g", 1, "S001", "https://a"), ("g", 2, "S002", "https://b")],
                                  "source string, document int, unit_id string, url string")
    claim = lambda refs, text="A whole claim": {"text": text, "sources": refs}
    answer = lambda **k: json.dumps({"common": [], "differences": [], "unique": [], **k})
    rows = {
        1: answer(common=[claim(["S001", "S002"])]), 2: answer(common=[claim(["S001", "S001"])]),
        3: answer(unique=[claim(["S001"])]), 4: answer(unique=[claim(["S999"])]), 5: answer(unique=[claim(["S001"], "short")]),
        6: answer(unique=[claim(["S001"])] * 6), 7: json.dumps({"common": []}), 8: answer(unique=[claim([])]),
    }
    df = spark.createDataFrame([(k, "g", v) for k, v in rows.items()], "answer_id long, source string, answer string")
    assert {r["answer_id"]: r["rule"] for r in C.comparison_validate(df, units).collect()} == {
        1: None, 2: "needs two documents", 3: None, 4: "unknown source", 5: "bad text", 6: "bad section",
        7: "bad section", 8: "unknown source"}
    text = {r["answer_id"]: r["report"] for r in C.comparison_render(df, units).collect()}
    assert set(text) == {1, 3} and "- A whole claim [S001](https://a) [S002](https://b)" in text[1]
    assert text[3].startswith("## 共通點\n\n目前引用的內容不足以確認。")


def test_balanced_excerpts_fit_their_share(spark):
    docs = [(i, "g", f"t{i}", f"u{i}", "alpha beta gamma. " * 3 + f"tail {i} words. " * 30, i != 4) for i in range(5)]
    docs += [(9, "single", "t", "u", "only one document here", True), (10, "g", "t", "u", " \n", True), (11, "g", "t", "u", "1 2 3 4", True)]
    df = spark.createDataFrame(docs, "doc_id long, source string, title string, url string, markdown string, success boolean")
    got = C.balanced_excerpts(df, budget=500, minimum=80).orderBy("document").collect()
    assert [(r["doc_id"], r["document"]) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    for r in got:
        body = r["text"].split("）：", 1)[1]
        assert len(body.replace("\n", "")) <= 100


def test_visual_note(spark):
    rows = [({"notes": []}, None, False), ({"notes": [{"frame_id": "F1", "title": "ok", "visual_evidence": "a chart"}]}, None, True),
            ({"notes": [{"frame_id": "F2", "title": "ok", "visual_evidence": "a chart"}]}, "other frame", False), ({}, "bad shape", False)]
    df = spark.createDataFrame([(i, "F1", json.dumps(a)) for i, (a, _, _) in enumerate(rows)], "i long, frame_id string, answer string")
    assert {r["i"]: (r["reject_reason"], r["has_note"]) for r in R.visual_note_check(df).collect()} == {
        i: (why, has) for i, (_, why, has) in enumerate(rows)}


def test_numbers_do_not_pass_as_text(spark):
    typed = spark.createDataFrame(
        [('{"a": "x", "b": ["y", 2, null], "c": true}',), ('{"a": 1, "b": "z", "c": "true"}',), ("[1]",), ("{",), (None,)],
        "j string").select(typed_json(F.col("j"), "a string, b array<string>, c boolean").alias("t"))
    assert [r["t"] and tuple(r["t"]) for r in typed.collect()] == [("x", ["y", None, None], True), (None, None, None), None, None, None]
    claim = lambda text: {"text": text, "sources": ["S001", "S002"]}
    answer = lambda text: json.dumps({"common": [claim(text)], "differences": [], "unique": []})
    answers = spark.createDataFrame(
        [(1, "a", answer("Both sources say so")), (2, "a", answer(123456789))], "answer_id long, source string, answer string")
    units = spark.createDataFrame([("a", n, f"S00{n}", "u", "t") for n in (1, 2)],
                                  "source string, document long, unit_id string, url string, text string")
    got = {r["answer_id"]: r["rule"] for r in C.comparison_validate(answers, units).collect()}
    assert got == {1: None, 2: "bad text"}


def test_replies_to_unknown_chunks_are_rejected_not_lost(spark):
    other = reply(spark, [note()]).withColumn("chunk_no", F.lit(7))
    cut = chunk(spark, "Keep your eyes")
    assert [r["reject_reason"] for r in N.note_validate(other, cut).collect()] == ["unknown chunk"]
    quote = spark.createDataFrame([(1, 7, 1, "eyes")], "video_id long, chunk_no int, note_no int, evidence string")
    assert [r["refs"] for r in N.quote_locate(quote, cut).collect()] == [[]]


def test_a_reply_is_parsed_once_in_each_branch(spark):
    """Parsing is bound, not repeated for every field that is read."""
    raw = spark.range(3).selectExpr("id as doc_id", "'openai' as provider", "cast(id as string) as raw", "array('S001') as allowed")
    answers = raw.withColumnRenamed("raw", "answer")
    for frame in (R.reply_decode(raw), R.summary_reply_check(answers), R.summary_render(answers)):
        frame = frame.withColumn("n", F.rand())  # keeps the plan from being evaluated ahead
        assert frame._jdf.queryExecution().analyzed().toString().count("try_parse_json") <= 1
