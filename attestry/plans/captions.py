"""Registered queries over captions: transcripts, blocks, samples, chunks, tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions as K
from ..session import written
from . import oracle_views as V
from .views import caption_tracks, turn_captions

CLOSING = "video_id % 3 = 0"


def speech_snippets(spark, folder):
    segments = turn_captions(spark, folder).withColumn("end_s", F.col("start_s") + F.col("duration_s"))
    return K.speech_snippets(segments.drop("duration_s")).select("video_id", "pos", "start_s", "duration_s", "text")


def transcript_lines(spark, folder):
    return K.transcript_format(turn_captions(spark, folder))


def transcript_texts(spark, folder):
    return K.transcript_text(transcript_lines(spark, folder))


def transcript_rejects(spark, folder):
    captions = turn_captions(spark, folder)
    return K.transcript_rejects(
        captions.withColumn("text", F.when(F.col("video_id") % 7 == 3, F.lit(" \n")).otherwise(F.col("text")))
    )


def caption_parse(spark, folder):
    return K.caption_parse(transcript_lines(spark, folder))


def caption_blocks(spark, folder):
    return K.caption_blocks(transcript_lines(spark, folder))


def blocks(spark, folder):
    """Blocks that several steps read."""
    return written(caption_blocks(spark, folder), "blocks")


def timeline_sample(spark, folder):
    return K.timeline_sample(blocks(spark, folder), budget=4000).select("video_id", "sampled", "unit_no", "unit_id", "text")


def closing_promo_trim(spark, folder):
    """Promotions at the end of videos; some of the given ones get a closing call to action."""
    cut = blocks(spark, folder)
    call = "Please subscribe and like and join, 訂閱 按讚"
    calls = cut.groupBy("video_id").agg((F.max("unit_no") + 1).alias("unit_no")).filter(CLOSING).select(
        "video_id", "unit_no", F.lit("S999").alias("unit_id"), F.lit(call).alias("text"))
    every = cut.select("video_id", "unit_no", "unit_id", "text").unionByName(calls)
    promos = K.closing_promos(every).select("video_id", F.col("promo").alias("promo_trimmed"))
    last = K.closing_promo_trim(every).groupBy("video_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_units"), F.max_by("unit_id", "unit_no").alias("last_unit"))
    return promos.join(last, "video_id")


def chunks_of(blocks):
    return K.chunk_units(K.caption_chunks(blocks))


def chunks(spark, folder):
    return chunks_of(blocks(spark, folder))


def caption_chunks(spark, folder):
    return chunks(spark, folder).select(
        "video_id", "chunk_no", F.size("units").alias("n_units"),
        F.col("units")[0]["unit_id"].alias("first_unit"),
        F.array_join(F.transform("units", lambda u: u["text"]), " ").alias("text"),
    )


def track_select(spark, folder):
    return K.track_select(caption_tracks(spark, folder))


QUERIES = {
    "speech_snippets": speech_snippets,
    "transcript_format": transcript_lines,
    "transcript_text": transcript_texts,
    "transcript_rejects": transcript_rejects,
    "caption_parse": caption_parse,
    "caption_blocks": caption_blocks,
    "timeline_sample": timeline_sample,
    "closing_promo_trim": closing_promo_trim,
    "caption_chunks": caption_chunks,
    "track_select": track_select,
}

ORACLES = {
    "speech_snippets": f"""with {V.C} select video_id, pos, cast(start_s as double) as start_s,
  cast(start_s + duration_s as double) - cast(start_s as double) as duration_s,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from c where regexp_matches(text, '\\S')""",
    "transcript_format": f"with {V.LINES} select video_id, pos, seconds, line from line",
    "transcript_text": f"""with {V.LINES} select video_id, string_agg(line, chr(10) || chr(10) order by pos) as text,
  false as truncated from line group by 1""",
    "transcript_rejects": """select distinct conv_id as video_id, 'no caption text' as reason from conversations
where conv_id % 7 = 3""",
    "caption_parse": f"""with recursive {V.BLOCKS}
select video_id, cast(n as integer) as n, time, url, seconds, text from cap""",
    "caption_blocks": f"with recursive {V.BLOCKS} select * from b",
    "timeline_sample": f"""with recursive {V.BLOCKS},
size as (select video_id, count(*) as n, sum(length(text)) as total, max(length(text)) as longest from b group by 1),
spots as (select distinct video_id, cast(round_even(i * (n - 1) / greatest(1, c - 1), 0) as integer) + 1 as unit_no
  from (select video_id, n, c, unnest(range(0, c)) as i
    from (select *, greatest(1, 4000 // longest) as c from size where total > 4000))),
picked as (select b.*, row_number() over (partition by b.video_id order by b.unit_no) as p
  from b join spots s on s.video_id = b.video_id and s.unit_no = b.unit_no),
fit as (
  select video_id, p, cast(case when length(text) <= 4000 then length(text) else 0 end as bigint) as used,
    length(text) <= 4000 as keep from picked where p = 1
  union all
  select x.video_id, x.p, case when f.used + length(x.text) <= 4000 then f.used + length(x.text) else f.used end,
    f.used + length(x.text) <= 4000
  from fit f join picked x on x.video_id = f.video_id and x.p = f.p + 1)
select b.video_id, false as sampled, unit_no, unit_id, text from b join size s on s.video_id = b.video_id and total <= 4000
union all
select x.video_id, true, unit_no, unit_id, text from picked x join fit f on f.video_id = x.video_id and f.p = x.p and f.keep""",
    "closing_promo_trim": f"""with recursive {V.BLOCKS},
last as (select video_id, max(unit_no) as n, max_by(text, unit_no) as t from b group by 1),
call as (select video_id, n, video_id % 3 = 0 as trim_it from last)
select video_id, trim_it as promo_trimmed, n as n_units,
  'S' || lpad(cast(n as varchar), 3, '0') as last_unit from call""",
    "caption_chunks": f"""with recursive {V.CHUNKS}
select video_id, chunk_no, cast(count(*) as integer) as n_units, min_by(unit_id, unit_no) as first_unit,
  string_agg(text, ' ' order by unit_no) as text from chunked group by 1, 2""",
    "track_select": """with t as (select doc_id // 4 as video_id, doc_id as pos, lang as language, doc_id % 2 = 1 as generated,
  coalesce(nullif(list_position(['zh-TW', 'zh-Hant', 'zh', 'zh-CN', 'zh-Hans', 'en', 'ja'], lang), 0), 99) as rank from documents)
select video_id, pos, language, generated from t
qualify row_number() over (partition by video_id order by rank, generated, pos) = 1""",
}
