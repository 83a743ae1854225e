"""Registered queries over frames, OCR boxes and their captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import normalize
from ..operators import align as A
from ..operators import evidence as E
from ..operators import frames as Fr
from ..operators import integrity as I
from ..operators import layout as L
from ..session import written
from . import oracle_views as V
from .captions import transcript_texts
from .views import (
    event_candidates, frame_boxes, frame_ocr_lines, ocr_boxes, plain_documents, short_captions,
    turn_frames, vector_features,
)


def sample_timestamps(spark, folder):
    spans = event_candidates(spark, folder).groupBy("video_id").agg(F.max("duration_s").alias("d"))
    videos = spans.select("video_id", (F.col("d") * (F.col("video_id") % 3 + 1)).alias("duration_s"))
    times = Fr.sample_timestamps(videos)
    rows = lambda kind: times.select(
        "video_id", "reject_reason", F.lit(kind).alias("kind"), F.posexplode_outer(kind).alias("n", "at_s")
    )
    return rows("retained").unionByName(rows("candidates"))


def frame_gate(spark, folder):
    return Fr.frame_gate(vector_features(spark, folder), min_mean=-0.04, min_std=0.118, min_change=0.133)


def keyframe_select(spark, folder):
    return Fr.keyframe_select(event_candidates(spark, folder))


def context(spark, folder):
    return A.caption_context_join(turn_frames(spark, folder), short_captions(spark, folder))


def caption_context_join(spark, folder):
    return context(spark, folder)


def longest_common_text(spark, folder):
    pairs = A.ocr_pairs(context(spark, folder), frame_ocr_lines(turn_frames(spark, folder)))
    return pairs.select("video_id", "frame_id", "rank", "ocr_pos", "shared")


def text_normalize(spark, folder):
    return plain_documents(spark, folder).select("doc_id", normalize(F.col("text")).alias("folded"))


def matched(spark, folder):
    frames = turn_frames(spark, folder).withColumn("lines", F.filter(F.split("ocr", "\n"), lambda line: line != ""))
    return A.overlap_match(frames, context(spark, folder))


def overlap_match(spark, folder):
    return matched(spark, folder)


def promo_frame_filter(spark, folder):
    return A.promo_frame_filter(turn_frames(spark, folder)).select("video_id", "frame_id", "ocr")


def novelty_filter(spark, folder):
    which = F.col("video_id") % 4
    said = (
        F.when(which == 0, F.concat(F.lit("A chart compares 9998 values, "), F.col("caption")))
        .when(which == 1, F.col("caption"))
        .when(which == 2, F.lit("The presenter stands by a rising line chart"))
        .otherwise(F.concat(F.lit("畫面顯示"), F.reverse("caption")))
    )
    notes = matched(spark, folder).withColumn("visual_evidence", said)
    return A.novelty_filter(notes).select(
        "video_id", "frame_id", "visual_evidence", F.round("similarity", 6).alias("similarity")
    )


def _ocr_items(spark, folder):
    return L.ocr_normalize(ocr_boxes(spark, folder), ["frame_id"])


def ocr_normalize(spark, folder):
    return _ocr_items(spark, folder)


def layout_pairs(spark, folder):
    return L.layout_pairs(_ocr_items(spark, folder), ["frame_id"])


def layout_rows(spark, folder):
    return L.layout_rows(_ocr_items(spark, folder), ["frame_id"])


def layout_hints(spark, folder):
    return _layout(turn_frames(spark, folder))


def _layout(frames):
    return L.layout_hints(frame_boxes(frames), ["video_id", "frame_id"])


def frame_sources(spark, folder):
    frames = turn_frames(spark, folder)
    return A.frame_sources(frames, context(spark, folder), _layout(frames))


def frame_gallery(spark, folder):
    return Fr.frame_gallery(turn_frames(spark, folder))


def gallery_counts(spark, folder):
    return Fr.gallery_counts(turn_frames(spark, folder))


def unnoted_frame_lines(spark, folder):
    frames = turn_frames(spark, folder)
    noted = A.promo_frame_filter(frames).filter(F.col("video_id") % 5 == 0)
    return Fr.unnoted_frame_lines(frames, noted, _layout(frames))


def evidence_records(spark, folder):
    frames = turn_frames(spark, folder).withColumn("sha256", F.sha2("ocr", 256))
    notes = matched(spark, folder).select(
        "video_id", "frame_id", F.substring("frame_id", 2, 9).cast("long").alias("pos"),
        F.concat(F.lit("Frame "), F.col("frame_id")).alias("title"),
        F.concat(F.lit("The frame shows text next to the words: "), F.col("caption")).alias("visual_evidence"),
        "caption", "caption_s", "ocr", "shared", "association",
        F.when(F.col("association") == "text-overlap", "openai").alias("provider"),
        F.concat(F.lit("reader-"), (F.col("video_id") % 2).cast("string")).alias("model"),
    )
    return E.evidence_records(written(notes, "notes"), frames, short_captions(spark, folder))


def bundle_verify(spark, folder):
    """Saved bundles, some of which have since lost or changed one thing."""
    kind = F.col("video_id") % 10
    frames = turn_frames(spark, folder).select("video_id", "frame_id", "file", "ocr")
    named = F.when((kind == 9) & (F.col("frame_id") == "F000"), F.concat(F.lit("../"), "file")).otherwise(F.col("file"))
    records = written(evidence_records(spark, folder).join(
        frames.select("video_id", "frame_id", named.alias("frame_file")), ["video_id", "frame_id"]), "records")
    texts = transcript_texts(spark, folder).select("video_id", F.lit("transcript.json").alias("name"), "text").filter(kind != 7)
    report = E.evidence_stats(records).select("video_id", F.lit("evidence.html").alias("name"), F.concat_ws(" ", "total", "decoders").alias("text"))
    capture = report.filter("video_id % 2 = 0").select("video_id", F.lit("capture.json").alias("name"), F.col("video_id").cast("string").alias("text"))
    contents = frames.select("video_id", F.col("file").alias("name"), F.col("ocr").alias("text")).unionByName(texts).unionByName(report).unionByName(capture)
    contents = written(contents, "contents")
    hashed = lambda text: F.sha2(text, 256).alias("sha256")
    headers = I.bundle_header(records, contents.select("video_id", "name", hashed(F.col("text"))))
    changed = (
        ((kind == 1) & (F.col("name") == "frames/F001.jpg")) | ((kind == 2) & (F.col("name") == "transcript.json"))
        | ((kind == 4) & (F.col("name") == "capture.json"))
    )
    files = contents.filter(~((kind == 3) & (F.col("name") == "evidence.html"))).select(
        "video_id", "name", hashed(F.when(changed, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    headers = headers.withColumn("schema_tag", F.when(kind == 6, "other").otherwise(F.col("schema_tag")))
    records = records.withColumn("summary", F.when(kind == 5, F.concat("summary", F.lit("x"))).otherwise(F.col("summary")))
    return I.bundle_verify(written(headers, "headers"), records, files)


def evidence_stats(spark, folder):
    return E.evidence_stats(evidence_records(spark, folder))


QUERIES = {
    "sample_timestamps": sample_timestamps,
    "frame_gate": frame_gate,
    "keyframe_select": keyframe_select,
    "caption_context_join": caption_context_join,
    "longest_common_text": longest_common_text,
    "text_normalize": text_normalize,
    "overlap_match": overlap_match,
    "promo_frame_filter": promo_frame_filter,
    "novelty_filter": novelty_filter,
    "ocr_normalize": ocr_normalize,
    "layout_pairs": layout_pairs,
    "layout_rows": layout_rows,
    "layout_hints": layout_hints,
    "frame_sources": frame_sources,
    "frame_gallery": frame_gallery,
    "gallery_counts": gallery_counts,
    "unnoted_frame_lines": unnoted_frame_lines,
    "evidence_records": evidence_records,
    "evidence_stats": evidence_stats,
    "bundle_verify": bundle_verify,
}

_NOTE_STAMP = """lpad(cast(seconds // 3600 as varchar), 2, '0') || ':' || lpad(cast(seconds // 60 % 60 as varchar), 2, '0')
    || ':' || lpad(cast(seconds % 60 as varchar), 2, '0')"""
_LINE_LINK = """'- [' || lpad(cast(seconds // 60 as varchar), 2, '0') || ':' || lpad(cast(seconds % 60 as varchar), 2, '0')
    || '](https://www.youtube.com/watch?v=' || code || '&t=' || seconds || 's) '"""

ORACLES = {
    "sample_timestamps": f"""with {V.CANDIDATES},
v as (select video_id, max(duration_s) * (video_id % 3 + 1) as d from cand group by video_id),
k as (select *, d <= 0 as bad, least(12, greatest(3, cast(round_even(d / 90, 0) as integer) + 2)) as c from v),
t as (
  select video_id, 'retained' as kind, i, round_even(least(5.0::double, d * 0.05::double)
    + (greatest(d * 0.92::double, d - 5) - least(5.0::double, d * 0.05::double)) * i / (c - 1), 2) as at_s
  from (select *, unnest(range(0, c)) as i from k where not bad)
  union all
  select video_id, 'candidates', i, round_even(least(3.0::double, d * 0.03::double)
    + (greatest(d * 0.97::double, d - 3) - least(3.0::double, d * 0.03::double)) * i / (least(48, c * 4) - 1), 2)
  from (select *, unnest(range(0, least(48, c * 4))) as i from k where not bad))
select video_id, null as reject_reason, kind, cast(i as integer) as n, at_s from t
union all select video_id, 'duration out of range', kind, null, null
  from k cross join (values ('retained'), ('candidates')) x(kind) where bad""",
    "frame_gate": """with recursive f as (
  select vec_id // 48 as series, vec_id as pos, list_transform(embedding, lambda x: x::double) as v, label * 10.0::double as edge from embeddings),
m as (select *, list_avg(v) as mean, list_stddev_pop(v) as std from f),
ok as (select *, row_number() over (partition by series order by pos) as n from m where mean >= -0.04 and std >= 0.118),
walk as (
  select series, n, pos, v as kept, true as keep, 20.0::double as change, std, edge from ok where n = 1
  union all
  select o.series, o.n, o.pos, case when d >= 0.133 then o.v else o.kept end, d >= 0.133, d, o.std, o.edge
  from (select x.series, x.n, x.pos, x.v, x.std, x.edge, w.kept,
      list_avg(list_transform(range(1, len(x.v) + 1), lambda i: abs(x.v[i] - w.kept[i]))) as d
    from walk w join ok x on x.series = w.series and x.n = w.n + 1) o)
select series, pos, round(change + std + least(edge, 500) / 10, 3) as selection_score from walk where keep""",
    "keyframe_select": f"""with {V.CANDIDATES},
seg as (select unnest(range(0, 12)) as i),
n as (select video_id, count(*) as n, max(duration_s) as d from cand group by 1),
best as (
  select c.video_id, i, c.pos from cand c join seg on c.duration_s * i / 12 <= at_s and at_s <= c.duration_s * (i + 1) / 12
  qualify row_number() over (partition by c.video_id, i order by score desc,
    abs(at_s - (c.duration_s * i / 12 + c.duration_s * (i + 1) / 12) / 2), c.pos) = 1),
gap as (
  select n.video_id, seg.i, c.pos from n cross join seg join cand c on c.video_id = n.video_id
  where not exists (select 1 from best b where b.video_id = n.video_id and b.i = seg.i)
  qualify row_number() over (partition by n.video_id, seg.i
    order by abs(at_s - (d * seg.i / 12 + d * (seg.i + 1) / 12) / 2), c.pos) = 1),
chosen as (select distinct video_id, pos from (select video_id, pos from best union all select video_id, pos from gap)),
k as (select video_id, count(*) as k from chosen group by 1),
rest as (
  select c.video_id, c.pos from cand c join k on k.video_id = c.video_id
  where not exists (select 1 from chosen x where x.video_id = c.video_id and x.pos = c.pos)
  qualify row_number() over (partition by c.video_id order by score desc, c.pos) <= 12 - any_value(k) over (partition by c.video_id)),
kept as (
  select c.video_id, c.pos from cand c join n on n.video_id = c.video_id and n.n <= 12
  union all select x.video_id, x.pos from (select * from chosen union all select * from rest) x
    join n on n.video_id = x.video_id and n.n > 12)
select k.video_id, cast(row_number() over (partition by k.video_id order by at_s, k.pos) as integer) as n, at_s, k.pos, score
from kept k join cand c on c.video_id = k.video_id and c.pos = k.pos""",
    "caption_context_join": f"""with {V.CONTEXT}
select video_id, frame_id, at_s, rank, distance, pos, start_s, duration_s, caption from near""",
    "longest_common_text": f"with {V.MATCH} select video_id, frame_id, rank, ocr_pos, shared from sharedpair",
    "text_normalize": r"""select doc_id, replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss') as folded from documents""",
    "overlap_match": f"with {V.MATCH} select video_id, frame_id, shared, ocr, caption, caption_s, association from matched",
    "promo_frame_filter": f"""with {V.FRAMES} select video_id, frame_id, ocr from fr
where cast(regexp_matches(ocr, '(?i)訂閱|按讚|小鈴鐺') as int) + cast(regexp_matches(ocr, '(?i)活動|挑戰') as int)
  + cast(regexp_matches(ocr, '(?i)開學季|優惠|折扣') as int) + cast(regexp_matches(ocr, '(?i)換你上場|參加') as int) < 2""",
    "ocr_normalize": f"with {V.OCR} select * from ocr",
    "layout_pairs": f"""with {V.OCR},
best as (
  select l.frame_id, l.n, l.text || ' ↔ ' || m.text as pair
  from ocr l join ocr m on m.frame_id = l.frame_id and m.y < l.y and abs(m.x - l.x) <= 90
  where regexp_full_match(l.text, '[A-Za-z0-9]{{2,8}}') and regexp_matches(l.text, '[A-Za-z]')
    and regexp_full_match(m.text, '[-+]?\\d+(?:[.,]\\d+)?%?')
  qualify row_number() over (partition by l.frame_id, l.n order by abs(m.x - l.x) + abs(m.y - l.y) * 0.1::double, m.n) = 1)
select frame_id, cast(row_number() over (partition by frame_id order by n) as integer) as n, pair from best
qualify count(*) over (partition by frame_id) >= 2""",
    "layout_rows": f"""with {V.OCR},
step as (select * from ocr where regexp_full_match(text, '[A-Z][A-Z0-9 _-]{{1,23}}')
  and length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 4),
line as (
  select a.frame_id, a.n, list(b.text order by b.x, b.n) as r from step a
  join step b on b.frame_id = a.frame_id and abs(b.y - a.y) <= 35 group by 1, 2)
select frame_id, cast(len(r) as integer) as length, array_to_string(r, ' → ') as line from line where len(r) >= 3
qualify row_number() over (partition by frame_id order by len(r) desc, n) = 1""",
    "layout_hints": f"with {V.FRAMES} select video_id, frame_id, hints from hint",
    "frame_sources": f"""with {V.CONTEXT}
select f.video_id, f.frame_id, '影格來源 ' || f.frame_id as title,
  coalesce(h.hints || '（OCR 位置線索，需核對影格）', '此影格尚無可靠的 AI 補充解讀，請直接核對圖片與字幕。') as visual_evidence,
  coalesce(n.caption, '') as caption, n.start_s as caption_s, f.ocr, '' as shared, 'temporal-only' as association
from fr f left join near n on n.video_id = f.video_id and n.frame_id = f.frame_id and n.rank = 1
left join hint h on h.video_id = f.video_id and h.frame_id = f.frame_id""",
    "frame_gallery": f"""with {V.FRAMES}, st as (select *, {_NOTE_STAMP} as stamp from fr)
select video_id, frame_id, seconds, '### [' || stamp || '](https://www.youtube.com/watch?v=' || code || '&t=' || seconds || 's)' as heading,
  '![' || stamp || ' 畫面](' || file || ')' as image from st""",
    "gallery_counts": f"""with {V.FRAMES} select video_id, count(*) as frames,
  count(*) filter (where decoder_status = 'hardware-verified') as hardware from fr group by 1""",
    "unnoted_frame_lines": f"""with {V.FRAMES},
bare as (select * from fr where video_id not in (select video_id from fr where video_id % 5 = 0 and not contains(ocr, '訂閱 活動')))
select b.video_id, b.frame_id, 'hint' as kind, {_LINE_LINK} || hints || '（依文字位置推定，請核對影格）' as line
  from bare b join hint h on h.video_id = b.video_id and h.frame_id = b.frame_id
union all
select video_id, frame_id, 'ocr', {_LINE_LINK} || replace(ocr, chr(10), '、') || '（OCR 可能誤字）' from bare""",
    "evidence_records": f"with {V.EVIDENCE} select * from record",
    "bundle_verify": f"""with {V.MATCH},
rec as (select video_id, frame_id, case when video_id % 10 = 9 and frame_id = 'F000' then '../' else '' end || 'frames/' || frame_id || '.jpg' as file from matched),
now as (select video_id, 'frames/' || frame_id || '.jpg' as file, sha256(ocr) as saved,
  sha256(ocr || case when video_id % 10 = 1 and frame_id = 'F001' then 'x' else '' end) as seen from fr),
sound as (select distinct video_id, video_id % 10 as kind from rec where video_id % 10 not in (5, 6))
select rec.video_id, rec.file as name, case when now.file is null then 'missing or unsafe' else 'hash mismatch' end as error
from rec join sound on sound.video_id = rec.video_id left join now on now.video_id = rec.video_id and now.file = rec.file
where now.file is null or saved <> seen
union all select video_id, 'transcript.json', case kind when 2 then 'hash mismatch' else 'transcript unavailable' end from sound where kind in (2, 7)
union all select video_id, 'evidence.html', 'missing or unsafe' from sound where kind = 3
union all select video_id, 'capture.json', 'hash mismatch' from sound where kind = 4
union all select distinct video_id, case video_id % 10 when 5 then '(records)' else '(header)' end,
  case video_id % 10 when 5 then 'hash mismatch' else 'unsupported schema' end from rec where video_id % 10 in (5, 6)""",
    "evidence_stats": f"""with {V.EVIDENCE} select video_id, count(*) as total,
  count(*) filter (where association = 'text-overlap') as text_overlap,
  count(*) filter (where association <> 'text-overlap') as temporal_only,
  array_to_string(list_sort(list(distinct decoder_status)), ', ') as decoders from record group by 1""",
}
