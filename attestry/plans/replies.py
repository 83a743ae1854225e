"""Registered queries over model replies, notes and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as M
from ..operators import compare as C
from ..operators import extract as X
from ..operators import notes as N
from ..operators import replies as R
from ..operators.segment import source_units, with_units
from ..session import written
from . import oracle_views as V
from .captions import blocks, chunks, chunks_of
from .views import (
    chunk_replies, comparison_answers, envelope_replies, merge_replies, note_replies, note_verdicts, plain_documents, saved_pages, turn_frames,
)


def balanced_excerpts(spark, folder):
    return C.balanced_excerpts(saved_pages(spark, folder))


def cross_source_summary(spark, folder):
    return C.cross_source_summary(saved_pages(spark, folder))


def comparison_validate(spark, folder):
    units = written(balanced_excerpts(spark, folder), "excerpts")
    return C.comparison_validate(comparison_answers(units), units)


def comparison_render(spark, folder):
    units = written(balanced_excerpts(spark, folder), "excerpts")
    return C.comparison_render(comparison_answers(units), units)


def decoded(spark, folder):
    return R.reply_decode(envelope_replies(spark, folder))


def reply_decode(spark, folder):
    return decoded(spark, folder).select("doc_id", "provider", "answer", "reject_reason")


def reply_decode_vision(spark, folder):
    return R.reply_decode(envelope_replies(spark, folder), vision=True).select(
        "doc_id", F.length("answer").alias("answer_chars"), "reject_reason"
    )


def summary_reply_check(spark, folder):
    """The document's reply, given for each of its chunks."""
    allowed = X.chunk_pack(plain_documents(spark, folder)).select(
        "doc_id", "chunk_no", F.array_distinct(R.cited_ids(F.col("chunk"))).alias("allowed")
    )
    return R.summary_reply_check(decoded(spark, folder).select("doc_id", "answer").join(allowed, "doc_id")).select(
        "doc_id", "chunk_no", "reject_reason"
    )


def drafts(spark, folder):
    answers = decoded(spark, folder).filter(F.col("reject_reason").isNull())
    return R.summary_render(answers).select("doc_id", "draft")


def summary_render(spark, folder):
    return drafts(spark, folder)


def citation_check(spark, folder):
    return R.citation_check(drafts(spark, folder), source_units(plain_documents(spark, folder)))


def citation_link(spark, folder):
    return R.citation_link(drafts(spark, folder), source_units(plain_documents(spark, folder))).select("doc_id", "linked")


def merged_answer(spark, folder):
    docs = written(with_units(plain_documents(spark, folder)).select("doc_id", "units"), "units")
    chunks = written(X.chunk_pack(docs), "chunks")
    return M.merged_answers(chunks, chunk_replies(chunks), merge_replies(chunks), source_units(docs), X.extractive_summary(docs))


def visual_note_check(spark, folder):
    no = F.col("pos")
    item = F.struct(
        F.when(no % 5 == 4, "F999").otherwise(F.col("frame_id")).alias("frame_id"),
        F.when(no % 7 == 3, "x").otherwise("Axis labels").alias("title"),
        F.col("ocr").alias("visual_evidence"),
    )
    replies = turn_frames(spark, folder).select(
        "video_id", "frame_id",
        F.to_json(F.struct(F.array_repeat(item, F.when(no % 3 == 2, 2).otherwise(1)).alias("notes"))).alias("answer"),
    )
    return R.visual_note_check(replies).select("video_id", "frame_id", "reject_reason", "has_note")


def quote_locate(spark, folder):
    cut = chunks(spark, folder)
    quotes = note_replies(cut).select(
        "video_id", "chunk_no",
        F.posexplode(F.from_json("answer", N.NOTES_SCHEMA)["notes"]).alias("i", "note"),
    ).select("video_id", "chunk_no", (F.col("i") + 1).alias("note_no"), "note.evidence")
    return N.quote_locate(quotes, cut).select(
        "video_id", "chunk_no", "note_no", F.array_join("refs", " ").alias("refs")
    )


def validated(spark, folder):
    cut = chunks(spark, folder)
    return N.note_validate(note_replies(cut), cut)


def note_validate(spark, folder):
    return validated(spark, folder).select(
        "video_id", "chunk_no", F.size("outline").alias("n_outline"), F.size("points").alias("n_points"),
        "dropped", "reject_reason",
    )


def note_validate_points(spark, folder):
    return N.explode_notes(validated(spark, folder), "points").withColumn("refs", F.array_join("refs", " "))


def gated(spark, folder):
    checked = written(validated(spark, folder), "validated")
    return N.claim_gate(checked, note_verdicts(N.explode_notes(checked, "points")))


def claim_gate(spark, folder):
    return gated(spark, folder).withColumn("refs", F.array_join("refs", " "))


def _merged(blocks):
    cut = written(chunks_of(blocks), "chunks")
    checked = written(N.note_validate(note_replies(cut), cut), "validated")
    gate = written(N.claim_gate(checked, note_verdicts(N.explode_notes(checked, "points"))), "gated")
    return N.note_timeline_merge(gate, blocks, checked, cut)


def note_timeline_merge(spark, folder):
    return _merged(blocks(spark, folder))


def video_report(spark, folder):
    """Reports, of which some videos have lost all notes of their replies."""
    cut = blocks(spark, folder)
    lost = (F.col("video_id") % 6 == 1) & F.col("section").isin("outline", "point")
    return N.video_report(_merged(cut).filter(~lost), cut)


QUERIES = {
    "balanced_excerpts": balanced_excerpts,
    "cross_source_summary": cross_source_summary,
    "comparison_validate": comparison_validate,
    "comparison_render": comparison_render,
    "reply_decode": reply_decode,
    "reply_decode_vision": reply_decode_vision,
    "summary_reply_check": summary_reply_check,
    "summary_render": summary_render,
    "citation_check": citation_check,
    "citation_link": citation_link,
    "merged_answer": merged_answer,
    "visual_note_check": visual_note_check,
    "quote_locate": quote_locate,
    "note_validate": note_validate,
    "note_validate_points": note_validate_points,
    "claim_gate": claim_gate,
    "note_timeline_merge": note_timeline_merge,
    "video_report": video_report,
}

_NL = "chr(10)"
_SUMMARY = (
    "'## 一句話摘要' || chr(10) || chr(10) || {said} || chr(10) || chr(10) || '## 重點' || chr(10) || chr(10) || '- ' || {said}"
    " || chr(10) || chr(10) || '## 重要數字／日期／條件' || chr(10) || chr(10) || '未提供' || chr(10) || chr(10)"
    " || '## 待確認事項' || chr(10) || chr(10) || '無'"
)

_MERGED = f"""with recursive {V.GATED},
ready as (
  select *, case when section = 'outline' then 'outline' when extractive then 'extract' else 'point' end as sec,
    replace(lower(regexp_replace(text, '\\s+', '', 'g')), 'ß', 'ss') as marker from gated where not failed),
kept as (
  select * from ready qualify row_number() over (partition by video_id, sec = 'outline', marker order by chunk_no, at_s, n) = 1),
lost as (select distinct video_id, chunk_no from lack where failed
  union select video_id, chunk_no from val where n_points = 0),
m as (
select video_id, sec as section, chunk_no, at_s, cast(n as integer) as n, case sec
  when 'outline' then '- **' || title || '** ' || links
  when 'extract' then '- 原句參考（AI 解讀未通過核對）：' || evidence || ' ' || links
  else '- ' || text || ' ' || links || {_NL} || '  字幕依據：「' || evidence || '」' end as line from kept
union all
select video_id, 'uncertain', min(chunk_no), 0, 0, '- unclear in part ' || chunk_no % 2 from val
  where video_id % 2 = 0 group by video_id, chunk_no % 2
union all
select o.video_id, 'failed', o.chunk_no, o.seconds, cast(o.n - 1 as integer), '- [' || time || '](' || url || ')：' || text
from off o join lost l on l.video_id = o.video_id and l.chunk_no = o.chunk_no)"""
_REPORT = r""",
shown as (select * from m where not (video_id % 6 = 1 and section in ('outline', 'point'))),
v_v as (select b.video_id, coalesce(bool_or(section = 'outline'), false) as o, coalesce(bool_or(section = 'point'), false) as p
  from (select distinct video_id from b) b left join shown s on s.video_id = b.video_id group by 1),
v_t as (select video_id, unit_no, unit_id, text, regexp_extract_all(lower(text), '[a-z]{3,}|[一-鿿]{2}') as tokens
  from b where video_id in (select video_id from v_v as v where not o and not p)),
v_x as (select video_id, unit_no, unnest(list_distinct(tokens)) as token from v_t as t),
v_xf as (select video_id, token, count(*) as df from v_x as x group by 1, 2),
v_xs as (select x.video_id, unit_no, sum(df) as s from v_x as x join v_xf as xf on xf.video_id = x.video_id and xf.token = x.token group by 1, 2),
v_r as (select t.*, row_number() over (partition by t.video_id order by coalesce(s, 0) / greatest(len(tokens), 1)
    + case when regexp_matches(text, '\d|重要|建議|注意|結論|截止|步驟') then 1.0 else 0.0 end desc, t.unit_no) as rank
  from v_t as t left join v_xs as xs on xs.video_id = t.video_id and xs.unit_no = t.unit_no),
v_k as (select video_id, string_agg('- [' || unit_id || '] ' || text, chr(10) order by unit_no) as line from v_r as r where rank <= 6 group by 1),
v_c as (select * from v_t as t where regexp_matches(text, '(?i)\b\d{4}[-/]\d{1,2}|\d+(?:\.\d+)?\s*(?:%|元|萬|億|美元|天|小時)|截止|報名|deadline|price|\$\d')
  qualify row_number() over (partition by video_id order by unit_no) <= 8),
v_f as (select video_id, string_agg('- [' || unit_id || '] ' || text, chr(10) order by unit_no) as line from v_c as c group by 1),
v_out as (
  select shown.video_id, section, cast(row_number() over (partition by shown.video_id, section order by chunk_no, at_s, n) as integer) as n, line
  from shown join v_v as v on v.video_id = shown.video_id where o or p or section = 'extract'
  union all select video_id, 'point', 1, '沒有額外可確認的重點。' from v_v as v where o and not p
  union all select video_id, 'outline', 1, '章節標題未通過檢查，請看下方已驗證引文的重點。' from v_v as v where p and not o
  union all select k.video_id, 'summary', 1, '## 重點摘錄（原文選句，非 AI 改寫）' || chr(10) || chr(10) || k.line
    || coalesce(chr(10) || chr(10) || '## 數字／日期／條件線索（請核對原文）' || chr(10) || chr(10) || f.line, '')
  from v_k as k left join v_f as f on f.video_id = k.video_id)
select video_id, cast(list_position(['summary', 'outline', 'point', 'uncertain', 'extract', 'failed'], section) - 1 as integer) as section_no,
  section, n, line from v_out as out"""

ORACLES = {
    "balanced_excerpts": f"with {V.EXCERPTS} select * from ex",
    "cross_source_summary": f"""with {V.EXCERPTS},
xtok as (select source, document, unit_id, text, regexp_extract_all(lower(text), '[a-z]{{3,}}|[一-鿿]{{2}}') as tokens from ex),
xd as (select source, document, unnest(list_distinct(tokens)) as token from xtok),
xf as (select source, token, count(*) as df from xd group by 1, 2),
xs as (select xd.source, document, sum(df) as s from xd join xf on xf.source = xd.source and xf.token = xd.token group by 1, 2),
xr as (select t.source, t.document, t.unit_id, t.text, row_number() over (partition by t.source order by
    coalesce(s, 0) / greatest(len(tokens), 1)
      + case when regexp_matches(text, '\\d|重要|建議|注意|結論|截止|步驟') then 1.0 else 0.0 end desc, t.document) as rank
  from xtok t left join xs on xs.source = t.source and xs.document = t.document)
select source, 'key' as section, document as n, '- [' || unit_id || '] ' || text as line from xr where rank <= 6
union all (select source, 'fact', document, '- [' || unit_id || '] ' || text from ex
  where regexp_matches(text, '(?i)\\b\\d{{4}}[-/]\\d{{1,2}}|\\d+(?:\\.\\d+)?\\s*(?:%|元|萬|億|美元|天|小時)|截止|報名|deadline|price|\\$\\d')
  qualify row_number() over (partition by source order by document) <= 8)
union all select source, 'failed', doc_id, url from saved where not success and source in (select source from room)
union all select source, 'source', document, document || '. ' || title || ' — ' || url from room""",
    "comparison_validate": f"with {V.ANSWERS} select answer_id, source, rule is null as accepted, rule from judged",
    "comparison_render": f"""with {V.ANSWERS},
good as (select j.*, e.url, o.unit_id as other, o.url as other_url from judged j
  join ex e on e.source = j.source and e.unit_id = j.unit_id
  join ex o on o.source = j.source and o.document = j.document - 1 where rule is null)
select answer_id, '## 共通點' || {_NL} || {_NL} || '- ' || text || ' [' || unit_id || '](' || url || ') ['
    || other || '](' || other_url || ')' || {_NL} || {_NL} || '## 差異與不同條件' || {_NL} || {_NL}
    || '目前引用的內容不足以確認。' || {_NL} || {_NL} || '## 個別來源重點' || {_NL} || {_NL}
    || '- Only source ' || document || ' says so [' || unit_id || '](' || url || ')' || {_NL}
    || '- Only source ' || document || ' says so [' || unit_id || '](' || url || ')' as report from good""",
    "reply_decode": f"""with {V.REPLIES} select doc_id, provider, answer,
  case when bad then 'not finished' end as reject_reason from decoded""",
    "reply_decode_vision": f"""with {V.REPLIES} select doc_id, cast(length('{{"overview":' || item || ',"points":[' || item
  || '],"facts":[],"uncertainties":"none"}}') as integer) as answer_chars, null as reject_reason from reply""",
    "summary_reply_check": rf"""with recursive {V.REPLIES}, {V.PLAIN}, {V.UNITS}, {V.PACKED},
held as (select doc_id, chunk_no, regexp_extract_all(chunk, '\[(S\d+)\]', 1) as ids from packed)
select d.doc_id, chunk_no, case when answer is null then 'bad shape'
  when len(refs) = 0 or not list_has_all(ids, refs) then 'unknown source' end as reject_reason
from decoded d join held on held.doc_id = d.doc_id""",
    "summary_render": f"with {V.REPLIES} select doc_id, draft from draft",
    "citation_check": f"""with {V.REPLIES}, {V.PLAIN}, {V.UNITS},
r as (select doc_id, unnest(refs) as unit_id from draft),
c as (select r.doc_id, count(*) as cited, count(*) - count(u.unit_id) as unknown
  from r left join u on u.doc_id = r.doc_id and u.unit_id = r.unit_id group by 1)
select d.doc_id, coalesce(cited, 0) as cited, coalesce(unknown, 0) as unknown,
  coalesce(cited, 0) = 0 or unknown > 0 as flagged from draft d left join c on c.doc_id = d.doc_id""",
    "citation_link": f"""with {V.REPLIES}, {V.PLAIN}, {V.UNITS}
select d.doc_id, case when a.doc_id is null then draft else replace(draft, '[S001]', '[S001](' || a.url || ')') end as linked
from draft d left join u a on a.doc_id = d.doc_id and a.unit_id = 'S001'""",
    "merged_answer": rf"""with recursive {V.PLAIN}, {V.UNITS}, {V.TOKENS}, {V.PACKED},
k as (select doc_id, string_agg('- [' || unit_id || '] ' || text, chr(10) order by unit_no) as t
  from ranked where rank <= 6 group by 1),
f as (select doc_id, string_agg('- [' || unit_id || '] ' || text, chr(10) order by unit_no) as t from facts group by 1),
c as (select *, (doc_id * 3 + chunk_no) % 17 = 0 as missing, (doc_id * 3 + chunk_no) % 13 = 0 as wrong,
  'Part ' || chunk_no || ' has ' || n_units || ' units [' || first_unit || ']' as said from packed),
p as (select doc_id, count(*) as n, min_by(first_unit, chunk_no) as a, max_by(first_unit, chunk_no) as b,
    min_by(case when missing then 'no reply' when wrong then 'unknown source' end, chunk_no) filter (missing or wrong) as broken,
    list(first_unit) as firsts, any_value(said) as one,
    string_agg('### 第 ' || chunk_no || ' 段' || chr(10) || chr(10) || {_SUMMARY.format(said="said")}, chr(10) || chr(10) order by chunk_no) as parts
  from c group by 1),
m as (select *, 'Whole of ' || n || ' parts ' || case when doc_id % 7 = 0 then '[S002]' else '[' || a || '] [' || b || ']' end as whole,
  case when broken is not null then 'chunk: ' || broken when n = 1 then null when doc_id % 5 = 0 then 'merge: no reply'
    when doc_id % 7 = 0 and not list_contains(firsts, 'S002') then 'merge: unknown source' end as reason from p)
select d.doc_id, coalesce(n, 0) as n_chunks, case when n is not null and reason is null then 'model' else 'extract' end as mode,
  case when n is null then 'no units' else reason end as reason, case when n is not null and reason is null then false end as flagged,
  case when n is not null and reason is null then regexp_replace(case when n = 1 then {_SUMMARY.format(said="one")}
    else {_SUMMARY.format(said="whole")} || chr(10) || chr(10) || '## 各段重點（保留全文脈絡）' || chr(10) || chr(10) || parts end,
    '\[(S\d+)\]', '[\1](' || d.url || ')', 'g')
  else '## 重點摘錄（原文選句，非 AI 改寫）' || chr(10) || chr(10) || coalesce(k.t, '可用文字不足，無法產生可靠摘要。')
    || coalesce(chr(10) || chr(10) || '## 數字／日期／條件線索（請核對原文）' || chr(10) || chr(10) || f.t, '') end as answer
from d left join m on m.doc_id = d.doc_id left join k on k.doc_id = d.doc_id left join f on f.doc_id = d.doc_id""",
    "visual_note_check": f"""with {V.FRAMES},
r as (select *, case when pos % 3 = 2 then 'bad shape' when pos % 5 = 4 then 'other frame'
  when pos % 7 = 3 then 'bad title'
  when length(regexp_replace(ocr, '^\\s+|\\s+$', '', 'g')) not between 5 and 400 then 'bad description' end as reject_reason from fr)
select video_id, frame_id, reject_reason, reject_reason is null as has_note from r""",
    "quote_locate": f"""with recursive {V.NOTES} select video_id, chunk_no, cast(n as integer) as note_no,
  coalesce(array_to_string(refs, ' '), '') as refs from located""",
    "note_validate": f"""with recursive {V.NOTES} select video_id, chunk_no, cast(n_outline as integer) as n_outline,
  cast(n_points as integer) as n_points, cast(dropped as integer) as dropped,
  case when n_points = 0 then 'nothing verified' end as reject_reason from val""",
    "note_validate_points": f"""with recursive {V.NOTES} select video_id, chunk_no, cast(n as integer) as n, title, text, evidence,
  array_to_string(refs, ' ') as refs from rules where good""",
    "claim_gate": f"""with recursive {V.GATED} select video_id, chunk_no, cast(n as integer) as n, title, text, evidence,
  array_to_string(refs, ' ') as refs, extractive, failed, section from gated""",
    "note_timeline_merge": _MERGED + " select * from m",
    "video_report": _MERGED + _REPORT,
}
