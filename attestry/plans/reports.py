"""Registered queries over manifests and report Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators import reports as R
from ..session import written
from ..sources.tables import load
from . import oracle_views as V
from .views import markdown_reports


def _manifest(spark, folder):
    return I.content_manifest(load(spark, folder, "documents", spread_by="doc_id"), name="doc_id", content="text")


def content_manifest(spark, folder):
    return _manifest(spark, folder)


def manifest_header(spark, folder):
    return I.manifest_header(_manifest(spark, folder)).drop("schema_tag")


def _altered(spark, folder):
    docs = load(spark, folder, "documents", spread_by="doc_id").filter(F.col("doc_id") % 19 != 0)
    text = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return I.content_manifest(docs.withColumn("text", text), name="doc_id", content="text")


def manifest_verify(spark, folder):
    manifest = written(_manifest(spark, folder), "manifest")
    return I.manifest_verify(manifest, _altered(spark, folder), I.manifest_header(manifest))


def manifest_verify_bad_header(spark, folder):
    manifest, altered = (written(make(spark, folder), "manifest") for make in (_manifest, _altered))
    return I.manifest_verify(manifest, altered, I.manifest_header(altered))


def report_sections(spark, folder):
    return R.report_sections(markdown_reports(spark, folder))


def report_blocks(spark, folder):
    return R.report_blocks(markdown_reports(spark, folder))


def report_tables(spark, folder):
    return R.report_tables(markdown_reports(spark, folder))


def report_links(spark, folder):
    return R.report_links(markdown_reports(spark, folder))


def inline_render(spark, folder):
    return markdown_reports(spark, folder).select("doc_id", R.inline_render(F.col("text")).alias("html"))


def section_graph_nodes(spark, folder):
    return R.section_graph(markdown_reports(spark, folder))[0]


def section_graph_edges(spark, folder):
    return R.section_graph(markdown_reports(spark, folder))[1]


QUERIES = {
    "content_manifest": content_manifest,
    "manifest_header": manifest_header,
    "manifest_verify": manifest_verify,
    "manifest_verify_bad_header": manifest_verify_bad_header,
    "report_sections": report_sections,
    "report_blocks": report_blocks,
    "report_tables": report_tables,
    "report_links": report_links,
    "inline_render": inline_render,
    "section_graph_nodes": section_graph_nodes,
    "section_graph_edges": section_graph_edges,
}

_MANIFEST = "m as (select cast(doc_id as varchar) as name, sha256(text) as sha256 from documents)"
_NOW = """n as (select cast(doc_id as varchar) as name, sha256(text || case when doc_id % 17 = 0 then 'x' else '' end) as sha256
  from documents where doc_id % 19 <> 0)"""
_CARDS = V.REPORTS + r""",
card as (
  select doc_id, n, lpad(cast(n as varchar), 2, '0') || '_' || case when s = '' then 'research-report' else s end || '.md' as name
  from (select doc_id, n, substring(trim(regexp_replace(title, '[^\p{L}\p{N}_-]+', '-', 'g'), '-_'), 1, 48) as s from section))"""

ORACLES = {
    "content_manifest": f"with {_MANIFEST} select name, sha256 from m",
    "manifest_header": f"""with {_MANIFEST},
h as (select sha256(sha256 || ' ' || name) as h from m)
select count(*) as entries, sha256(concat_ws(' ', {', '.join(
    f"cast(sum(cast('0x' || substring(h, {i * 8 + 1}, 8) as hugeint)) as varchar)" for i in range(8))})) as header_sha256 from h""",
    "manifest_verify": f"""with {_MANIFEST}, {_NOW}
select m.name, case when n.name is null then 'missing or unsafe' else 'hash mismatch' end as error
from m left join n on n.name = m.name where n.sha256 is distinct from m.sha256""",
    "manifest_verify_bad_header": f"""with {_MANIFEST}, {_NOW},
differ as (select count(*) as k from m full join n on n.name = m.name where n.sha256 is distinct from m.sha256)
select '(header)' as name, 'hash mismatch' as error from differ where k > 0""",
    "report_sections": f"with {V.REPORTS} select doc_id, n, title, body from section",
    "report_blocks": f"""with {V.REPORTS}
select doc_id, cast(row_number() over (partition by doc_id order by g) as integer) as n, kind, content, lines
from block where kind <> 'blank'""",
    "report_tables": f"""with {V.REPORTS},
tab as (select doc_id, cast(row_number() over (partition by doc_id order by g) as integer) as table_no,
  string_split(content, chr(10)) as rows from block where kind = 'table'),
tr as (select doc_id, table_no, unnest(rows) as row, generate_subscripts(rows, 1) as r from tab),
td as (select doc_id, table_no, r, string_split(trim(row, '|'), '|') as cells from tr),
ok as (select *, cast(row_number() over (partition by doc_id, table_no order by r) as integer) as row_no
  from td where len(list_filter(cells, lambda c: not regexp_full_match(trim(c), ':?-+:?'))) > 0)
select doc_id, table_no, row_no, cast(c as integer) as col_no, trim(cells[c]) as cell
from (select *, unnest(range(1, len(cells) + 1)) as c from ok)""",
    "report_links": f"""with {V.REPORTS}
select doc_id, 1 as n, 'image' as kind, 'frame' as label, 'frames/' || doc_id || '.jpg' as target from h
union all select doc_id, 1, 'link', 'link', 'https://example.com/' || doc_id from h""",
    "inline_render": rf"""with {V.REPORTS},
e as (select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&quot;'), '''', '&#x27;') as t from h)
select doc_id, regexp_replace(regexp_replace(regexp_replace(t,
  '\[([^\]]+)\]\((https?://[^)]+)\)', '<link href="\2" color="#0066cc">\1</link>', 'g'),
  '`([^`]+)`', '<font face="Courier">\1</font>', 'g'), '\*\*([^*]+)\*\*', '<b>\1</b>', 'g') as html from e""",
    "section_graph_nodes": f"""with {_CARDS}
select doc_id, substring(sha256(name), 1, 16) as node_id, 'cards/' || name as file, 0 as x, (n - 1) * 300 as y,
  520 as width, 240 as height from card
union all select doc_id, substring(sha256('01_' || doc_id || '.jpg'), 1, 16), 'assets/01_' || doc_id || '.jpg', 620, 0, 520, 300 from h""",
    "section_graph_edges": f"""with {_CARDS}
select doc_id, 'e' || lpad(cast(n as varchar), 3, '0') as edge_id, substring(sha256(prev), 1, 16) as from_node,
  substring(sha256(name), 1, 16) as to_node
from (select *, lag(name) over (partition by doc_id order by n) as prev from card) where prev is not null""",
}
