"""Registered queries over URLs, fetch logs and saved results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import urls as U
from ..sources.tables import load
from . import oracle_views as V
from .views import documents_plus, fetch_log, saved_pages


def page_urls(spark, folder):
    """Page URLs with derived bad and repeated forms, several per page, in a fixed order."""
    url = F.col("url")
    forms = F.array(
        url,
        F.concat(F.lit("  "), url, F.lit("#part")),
        F.regexp_replace(url, r"\Ahttps?://", "https://user:secret@"),
        F.regexp_replace(url, r"\A(https?://[^/]*)/", "$1:bad/"),
        F.concat(url, F.lit(" x")),
        F.regexp_replace(url, r"\Ahttps?:", "file:"),
        F.concat(F.lit("HTTPS://EXAMPLE.com?id="), F.col("page_id").cast("string")),
        F.lit("  "),
        F.lit("hello"),
        F.lit("https://example.com/#x"),
    )
    return load(spark, folder, "pages").select("page_id", F.posexplode(forms).alias("form", "url")).withColumn(
        "pos", F.col("page_id") * 10 + F.col("form")
    )


def url_canonicalize(spark, folder):
    return U.url_canonicalize(page_urls(spark, folder)).select("pos", "url", "canonical", "reject_reason")


def url_dedupe(spark, folder):
    return U.url_dedupe(U.url_canonicalize(page_urls(spark, folder)).select("canonical", "pos", "url"))


def source_route(spark, folder):
    code = F.lpad(F.col("page_id").cast("string"), 11, "a")
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), code, F.lit("&t=3s")),
        F.concat(F.lit("https://youtu.be/"), code),
        F.concat(F.lit("https://m.youtube.com/shorts/"), code, F.lit("/")),
        F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), code),
        F.concat(F.lit("https://youtube.com.example.org/watch?v="), code),
        F.concat(F.lit("https://www.youtube.com/playlist?list="), code),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("page_id").cast("string")),
        F.concat(F.lit("https://music.youtube.com/@channel"), code),
    )
    urls = load(spark, folder, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))
    return U.source_route(urls)


def outcomes(spark, folder):
    return R.fetch_outcome(fetch_log(spark, folder))


def status_reason(spark, folder):
    log = fetch_log(spark, folder).filter(F.col("status").isNotNull() & (F.col("status") != 200))
    return R.status_reason(log).select("url", "attempt", "status", "reason")


def results_export(spark, folder):
    return R.guard_columns(documents_plus(spark, folder)).select("doc_id", "title", "text")


def _run_tables(spark, folder):
    log = fetch_log(spark, folder)
    done = R.fetch_outcome(log).filter("not transient").select("run_id", "url", "success").withColumn(
        "summary", F.when(F.length("url") % 2 == 0, "done").otherwise("")
    )
    return log.select("run_id", "url"), done


def run_manifest(spark, folder):
    return R.run_manifest(*_run_tables(spark, folder))


def run_progress(spark, folder):
    return R.run_progress(*_run_tables(spark, folder))


def result_search(spark, folder):
    return R.result_search(saved_pages(spark, folder), query=" Deadline ").select("doc_id", "url", "label")


def result_search_failed(spark, folder):
    return R.result_search(saved_pages(spark, folder), show="failed", query="404").select("doc_id", "label")


def outcome_rollup(spark, folder):
    return R.outcome_rollup(outcomes(spark, folder))


def retry_urls(spark, folder):
    return R.retry_urls(outcomes(spark, folder))


def safe_names(spark, folder):
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    return documents_plus(spark, folder).select(
        "doc_id",
        R.page_name(F.col("title"), F.col("doc_id")).alias("page_title"),
        R.page_name(first_line, F.col("doc_id")).alias("page_name"),
        R.report_name(first_line).alias("report_name"),
        R.report_name(F.col("title")).alias("report_title"),
    )


QUERIES = {
    "url_canonicalize": url_canonicalize,
    "url_dedupe": url_dedupe,
    "source_route": source_route,
    "fetch_outcome": outcomes,
    "status_reason": status_reason,
    "results_export": results_export,
    "run_manifest": run_manifest,
    "run_progress": run_progress,
    "result_search": result_search,
    "result_search_failed": result_search_failed,
    "outcome_rollup": outcome_rollup,
    "retry_urls": retry_urls,
    "safe_names": safe_names,
}

_FORMS = r"""forms as (
  select page_id, unnest(l) as url, generate_subscripts(l, 1) - 1 as form from (
    select page_id, [url, '  ' || url || '#part',
      regexp_replace(url, '^https?://', 'https://user:secret@'),
      regexp_replace(url, '^(https?://[^/]*)/', '\1:bad/'),
      url || ' x', regexp_replace(url, '^https?:', 'file:'),
      'HTTPS://EXAMPLE.com?id=' || page_id, '  ', 'hello', 'https://example.com/#x'] as l from pages)),
parts as (
  select page_id * 10 + form as pos, url, trim(url) as v,
    lower(regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', 1)) as scheme,
    lower(regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', 2)) as netloc,
    regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) as path,
    regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4) as query
  from forms where trim(url) <> ''),
reasoned as (
  select *, case when contains(v, ' ') then 'inner whitespace'
      when scheme not in ('http', 'https') then 'not http or https'
      when netloc = '' then 'no host'
      when contains(netloc, '@') then 'user or password'
      when regexp_matches(netloc, ':.*[^0-9]') then 'bad port' end as reject_reason from parts),
canon as (
  select pos, url, reject_reason, case when reject_reason is null then
      scheme || '://' || netloc || case when path = '' then '/' else path end || query end as canonical from reasoned)"""

_ROUTE = """forms as (
  select page_id, unnest(l) as url, cast(generate_subscripts(l, 1) - 1 as integer) as form from (
    select page_id, [url, 'https://www.youtube.com/watch?v=' || c || '&t=3s', 'https://youtu.be/' || c,
      'https://m.youtube.com/shorts/' || c || '/', 'https://www.youtube-nocookie.com/embed/' || c,
      'https://youtube.com.example.org/watch?v=' || c, 'https://www.youtube.com/playlist?list=' || c,
      'https://www.youtube.com/watch?v=' || page_id, 'https://music.youtube.com/@channel' || c] as l
    from (select page_id, url, lpad(cast(page_id as varchar), 11, 'a') as c from pages)))"""

_RUN = V.LOG + """,
done as (select run_id, url, success, case when length(url) % 2 = 0 then 'done' else '' end as summary
  from outcome where not transient),
inputs as (select distinct run_id, url from log)"""

ORACLES = {
    "url_canonicalize": f"with {_FORMS} select pos, url, canonical, reject_reason from canon",
    "url_dedupe": f"""with {_FORMS} select canonical, pos, url from canon where canonical is not null
qualify row_number() over (partition by canonical order by pos) = 1""",
    "source_route": f"""with {_ROUTE},
host as (select *, split_part(split_part(url, '://', 2), '/', 1) as host,
  string_split(split_part(split_part(url, '://', 2), '?', 1), '/') as path from forms),
wanted as (select *, host in ('youtu.be', 'www.youtu.be') as short,
  host in ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'music.youtube.com',
    'youtube-nocookie.com', 'www.youtube-nocookie.com') as video from host),
code as (select *, case when short then path[2] when path[2] = 'watch' then regexp_extract(url, '[?&]v=([^&]+)', 1)
  when path[2] in ('shorts', 'embed', 'live') then coalesce(path[3], '') else '' end as code from wanted)
select page_id, form, url,
  case when not short and not video then null when video and code = '' then 'not a single video'
    when not regexp_full_match(code, '[A-Za-z0-9_-]{{11}}') then 'bad video id' end as route_error,
  case when not short and not video then 'web'
    when regexp_full_match(code, '[A-Za-z0-9_-]{{11}}') then 'youtube' else 'rejected' end as source_type,
  case when (short or video) and regexp_full_match(code, '[A-Za-z0-9_-]{{11}}') then code end as video_id
from code""",
    "fetch_outcome": f"with {V.LOG} select * from outcome",
    "status_reason": f"""with {V.LOG}
select url, attempt, status, case status when 400 then '模型或輸出格式不支援，請換用支援 JSON Schema 的文字模型'
  when 401 then 'API 金鑰無效' when 403 then '帳號沒有此模型的存取權限' when 404 then '找不到模型或 API'
  when 429 then 'API 額度不足或請求過於頻繁' else 'AI 服務暫時無法使用（HTTP ' || status || '）' end as reason
from log where status is not null and status <> 200""",
    "results_export": f"""with {V.D}
select doc_id, case when regexp_matches(title, '^\\s*[=+@-]') then '''' || title else title end as title,
  case when regexp_matches(text, '^\\s*[=+@-]') then '''' || text else text end as text from d""",
    "run_manifest": f"""with {_RUN}
select i.run_id, 'state' as kind, case when count(*) > count(d.url) then 'running ' else 'completed ' end
    || count(d.url) as value
  from inputs i left join done d on i.run_id = d.run_id and i.url = d.url group by 1
union all select run_id, 'pending', url from inputs i
  where not exists (select 1 from done d where d.run_id = i.run_id and d.url = i.url)
union all select run_id, 'summary_pending', url from done where success and summary = ''""",
    "run_progress": f"""with {_RUN}
select i.run_id, count(d.url) as completed, count(*) - count(d.url) as pending,
  count(*) filter (where d.success and d.summary = '') as summary_pending,
  case when count(*) > count(d.url) then 'running' else 'completed' end as state
from inputs i left join done d on i.run_id = d.run_id and i.url = d.url group by 1""",
    "result_search": f"""with {V.SAVED}
select doc_id, url, case when not success then '失敗' when summary_mode = '尚未完成' then '整理中'
  when summary_mode = '基本摘錄' then '基本摘錄' else '完成' end as label
from saved where contains(lower(url || ' ' || title || ' ' || markdown || ' ' || summary || ' ' || error), 'deadline')""",
    "result_search_failed": f"""with {V.SAVED}
select doc_id, '失敗' as label from saved where not success
  and contains(lower(url || ' ' || title || ' ' || markdown || ' ' || summary || ' ' || error), '404')""",
    "outcome_rollup": f"""with {V.LOG}
select run_id, count(*) filter (where success) as succeeded, count(*) filter (where not success) as failed,
  count(*) as processed from outcome group by 1""",
    "retry_urls": f"with {V.LOG} select run_id, url from outcome where not success",
    "safe_names": f"""with {V.D},
n as (select doc_id, title, split_part(text, chr(10), 1) as line,
  case when doc_id < 1000 then lpad(cast(doc_id as varchar), 3, '0') else cast(doc_id as varchar) end as num from d),
s as (select doc_id, num,
  substring(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), 1, 36) as t,
  substring(regexp_replace(line, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), 1, 36) as p,
  substring(trim(regexp_replace(line, '[^\\p{{L}}\\p{{N}}_-]+', '-', 'g'), '-_'), 1, 48) as r,
  substring(trim(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_-]+', '-', 'g'), '-_'), 1, 48) as rt from n)
select doc_id, num || '_' || case when t = '' then 'page' else t end as page_title,
  num || '_' || case when p = '' then 'page' else p end as page_name,
  case when r = '' then 'research-report' else r end as report_name,
  case when rt = '' then 'research-report' else rt end as report_title from s""",
}
