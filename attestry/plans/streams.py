"""Registered queries over sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import pages as P
from ..sources import results as S
from ..sources.tables import load, table_stream
from ..streaming import blocks, ingest, progress
from . import oracle_views as V
from .views import saved_pages

BLOCK_SPAN = 12 * 3600


def _target(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def page_extract(spark, folder):
    pages = load(spark, folder, "pages", spread_by="page_id").select("page_id", "url", "html")
    return P.page_extract(pages).select("page_id", "url", "title", "text", F.size("links").alias("n_links"), "success", "error")


def _saved_with_files(spark, folder):
    name = F.when(F.col("doc_id") % 9 == 0, "../outside.md").when(F.col("doc_id") % 9 == 1, "a:b.md").otherwise(
        F.concat(F.col("doc_id").cast("string"), F.lit("_page.md"))
    )
    return saved_pages(spark, folder).withColumn("file", name)


def results_csv(spark, folder):
    """The CSV export, read back."""
    target = _target(spark, "results")
    S.write_results(_saved_with_files(spark, folder), target)
    back = spark.read.csv(f"{target}/results.csv", header=True, escape='"', multiLine=True, schema=(
        "url string, final_url string, title string, success string, status string, file string"))
    return back.select("url", "title", "success", "file")


def results_load(spark, folder):
    """The JSON export, read back and checked."""
    target = _target(spark, "results")
    S.write_results(_saved_with_files(spark, folder), target)
    valid, quarantine = S.results_load(spark, f"{target}/results.json")
    return valid.select("url", "success", "file", F.lit("").alias("reason")).unionByName(
        quarantine.select("url", "success", "file", "reason")
    )


def _ingested(spark, folder):
    """The pages table, whose parts arrive together, whenever their files were written."""
    target = _target(spark, "ingest")
    pages = table_stream(spark, folder, "pages").withColumn("arrived_at", F.current_timestamp())
    ingest.stream_page_ingest(pages, target).awaitTermination()
    return target


def stream_page_ingest(spark, folder):
    target = _ingested(spark, folder)
    return spark.read.parquet(f"{target}/raw").select("canonical")


def stream_page_units(spark, folder):
    target = _ingested(spark, folder)
    return spark.read.parquet(f"{target}/units").select("page_id", "unit_no", "unit_id", "url", "text")


def _run_events(events):
    return events.select(
        (F.col("user_id") % 10).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("event_type").alias("state"), (F.col("event_type") != "error").alias("ok"),
    )


def stream_run_progress(spark, folder):
    target = _target(spark, "progress")
    events = table_stream(spark, folder, "events")
    progress.stream_run_progress(_run_events(events), target).awaitTermination()
    return progress.latest_progress(spark, target)


def batch_run_progress(spark, folder):
    return progress.run_progress(_run_events(load(spark, folder, "events")))


def stream_caption_blocks(spark, folder):
    """Events as captions; one closing row far in the future lets the last blocks out.

    Files are taken as they were written, not by event time, so any file may hold times
    older than all before it: the lateness of the replay is the whole span of the table.
    """
    source, target = _target(spark, "captions"), _target(spark, "blocks")
    captions = load(spark, folder, "events").select(
        F.col("user_id").alias("video_id"), "ts", F.col("event_id").alias("pos"), F.col("props").alias("text")
    )
    captions.write.parquet(f"{source}/part=1")
    ends = spark.read.schema(captions.schema).parquet(f"{source}/part=1").agg(F.min("ts").alias("first"), F.max("ts").alias("ts"))
    span = ends.select(F.coalesce(F.unix_seconds("ts") - F.unix_seconds("first"), F.lit(0))).first()[0] + 3600
    closing = ends.select(
        F.lit(-1).cast("long").alias("video_id"), (F.col("ts") + F.make_dt_interval(days=F.lit(30), secs=F.lit(span))).alias("ts"),
        F.lit(0).cast("long").alias("pos"), F.lit("").alias("text"),
    )
    closing.write.parquet(f"{source}/part=2")
    stream = spark.readStream.schema(captions.schema).option("maxFilesPerTrigger", 8).parquet(f"{source}/part=*")
    query = blocks.stream_caption_blocks(stream, target, span=BLOCK_SPAN, chars=1000, lateness=f"{span} seconds")
    query.awaitTermination()
    if late := blocks.late_captions(query):
        raise RuntimeError(f"{late} captions came too late for their blocks")
    return spark.read.schema(blocks.OUTPUT).parquet(f"{target}/blocks").filter("video_id >= 0")


QUERIES = {
    "page_extract": page_extract,
    "results_csv": results_csv,
    "results_load": results_load,
    "stream_page_ingest": stream_page_ingest,
    "stream_page_units": stream_page_units,
    "stream_run_progress": stream_run_progress,
    "batch_run_progress": batch_run_progress,
    "stream_caption_blocks": stream_caption_blocks,
}

_PAGE = r"""page as (
  select page_id, url,
    trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) as rt,
    regexp_replace(regexp_replace(html, '(?s)<title>.*?</title>|<style>.*?</style>|<script>.*?</script>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', '', 'g'),
      '\s+', ' ', 'g') as body from pages),
plain as (
  select page_id, url, rt, string_split(regexp_replace(regexp_replace(body, '</?(?:p|br|div|article|h1|html|body|li|ul)(?: [^>]*)?>', chr(10), 'g'),
    '<[^>]*>', '', 'g'), chr(10)) as parts from page),
decoded as (
  select page_id, url,
    replace(replace(rt, '&quot;', '"'), '&amp;', '&') as title,
    replace(replace(array_to_string(list_filter(list_transform(parts, lambda p: trim(p)), lambda p: p <> ''), chr(10)),
      '&quot;', '"'), '&amp;', '&') as text from plain)"""
_CANON = """regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]*)$', '\\1/')"""
_PROGRESS = """select user_id % 10 as run_id, epoch_us(ts) // 86400000000 * 86400 as began, count(*) as events,
  count(*) filter (where event_type <> 'error') as succeeded, count(*) filter (where event_type = 'error') as failed,
  max_by(event_type, (ts, event_id)) as latest_state from events group by 1, 2"""

ORACLES = {
    "page_extract": f"""with {_PAGE} select page_id, url, title, text, cast(0 as integer) as n_links,
  text <> '' as success, case when text = '' then 'page has no text to extract' else '' end as error from decoded""",
    "results_csv": f"""with {V.SAVED} select url, case when title = 'plain' then title else '''' || title end as title,
  cast(success as varchar) as success, case when doc_id % 9 = 0 then '../outside.md' when doc_id % 9 = 1 then 'a:b.md'
    else doc_id || '_page.md' end as file from saved""",
    "results_load": f"""with {V.SAVED} select url, success, case when doc_id % 9 = 0 then '../outside.md'
    when doc_id % 9 = 1 then 'a:b.md' else doc_id || '_page.md' end as file,
  case when doc_id % 9 < 2 then 'bad file name' else '' end as reason from saved""",
    "stream_page_ingest": f"select distinct {_CANON} as canonical from pages",
    "stream_page_units": f"""with {_PAGE},
stored as (select {_CANON} as canonical, min(page_id) as page_id from pages group by 1),
d as (select s.page_id as doc_id, s.canonical as url, p.text from stored s
  join decoded p on p.page_id = s.page_id where p.text <> ''),
{V.UNITS}
select doc_id as page_id, unit_no, unit_id, url, text from u""",
    "stream_run_progress": _PROGRESS,
    "batch_run_progress": _PROGRESS,
    "stream_caption_blocks": f"""with recursive ev as (
  select user_id as video_id, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as n,
    epoch_us(ts) // 1000 as at_ms, props as text from events),
walk as (
  select video_id, n, 1 as block, at_ms as begin_at, cast(length(text) as bigint) as size from ev where n = 1
  union all
  select video_id, next_n, case when o then block + 1 else block end, case when o then at_ms else begin_at end,
    case when o then len else size + len + 1 end
  from (select w.video_id, x.n as next_n, w.block, w.begin_at, w.size, x.at_ms, length(x.text) as len,
      x.at_ms - w.begin_at >= {BLOCK_SPAN * 1000} or w.size + length(x.text) > 1000 as o
    from walk w join ev x on x.video_id = w.video_id and x.n = w.n + 1))
select w.video_id, min(e.at_ms) as start_ms, cast(count(*) as integer) as n_captions, string_agg(text, ' ' order by e.n) as text
from walk w join ev e on e.video_id = w.video_id and e.n = w.n group by w.video_id, block""",
}
