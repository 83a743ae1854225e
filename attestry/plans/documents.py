"""Registered queries over documents: units, tokens, summaries, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import segment as S
from . import oracle_views as V
from .views import documents_plus, plain_documents


def source_units(spark, folder):
    return S.source_units(documents_plus(spark, folder)).select("doc_id", "unit_no", "unit_id", "text", "url")


def unit_tokens(spark, folder):
    tokens = S.unit_tokens(S.source_units(plain_documents(spark, folder)))
    return tokens.select(
        "doc_id", "unit_no",
        F.size("tokens").alias("n_tokens"), F.size("distinct_tokens").alias("n_distinct"),
        F.array_join(F.array_sort("distinct_tokens"), " ").alias("tokens"),
    )


def token_df(spark, folder):
    return X.document_df(plain_documents(spark, folder))


def key_sentences(spark, folder):
    return X.key_sentences(plain_documents(spark, folder)).select(
        "doc_id", "unit_no", "unit_id", "rank", F.round("score", 6).alias("score"), "text"
    )


def fact_clues(spark, folder):
    return X.fact_clues(documents_plus(spark, folder)).select("doc_id", "unit_no", "unit_id", "text")


def extractive_summary(spark, folder):
    return X.extractive_summary(documents_plus(spark, folder))


def char_budget(spark, folder):
    return X.char_budget(plain_documents(spark, folder))


def char_budget_tight(spark, folder):
    return X.char_budget(plain_documents(spark, folder), budget=2000)


def chunk_pack(spark, folder):
    return X.chunk_pack(plain_documents(spark, folder))


QUERIES = {
    "source_units": source_units,
    "unit_tokens": unit_tokens,
    "token_df": token_df,
    "key_sentences": key_sentences,
    "fact_clues": fact_clues,
    "extractive_summary": extractive_summary,
    "char_budget": char_budget,
    "char_budget_tight": char_budget_tight,
    "chunk_pack": chunk_pack,
}


def _budget(limit: int) -> str:
    return f"""with {V.PLAIN}, {V.UNITS},
run as (select *, sum(length(unit_id) + length(text) + 3) over (partition by doc_id order by unit_no) as cum,
    sum(length(unit_id) + length(text) + 3) over (partition by doc_id) as total from u)
select r.doc_id, unit_no, unit_id, total > {limit} as truncated, false as source_truncated, r.text
from run r join d on r.doc_id = d.doc_id where cum <= {limit}"""


ORACLES = {
    "source_units": f"with {V.D}, {V.UNITS} select doc_id, unit_no, unit_id, text, url from u",
    "unit_tokens": f"""with {V.PLAIN}, {V.UNITS}, {V.TOKENS}
select doc_id, unit_no, len(tokens) as n_tokens, len(list_distinct(tokens)) as n_distinct,
  array_to_string(list_sort(list_distinct(tokens)), ' ') as tokens from tok""",
    "token_df": f"with {V.PLAIN}, {V.UNITS}, {V.TOKENS} select doc_id, token, df from df",
    "key_sentences": f"""with {V.PLAIN}, {V.UNITS}, {V.TOKENS}
select doc_id, unit_no, unit_id, cast(rank as integer) as rank, round(score, 6) as score, text
from ranked where rank <= 6""",
    "fact_clues": f"with {V.D}, {V.UNITS}, {V.TOKENS} select doc_id, unit_no, unit_id, text from facts",
    "extractive_summary": f"""with {V.D}, {V.UNITS}, {V.TOKENS},
k as (select doc_id, string_agg('- [' || unit_id || '] ' || text, chr(10) order by unit_no) as t
  from ranked where rank <= 6 group by 1),
f as (select doc_id, string_agg('- [' || unit_id || '] ' || text, chr(10) order by unit_no) as t from facts group by 1),
s as (select doc_id, count(*) as n, string_agg('### [' || unit_id || ']' || chr(10) || chr(10) || text || chr(10) || chr(10)
  || '來源：' || url, chr(10) || chr(10) order by unit_no) as t from u group by 1)
select d.doc_id, cast(coalesce(s.n, 0) as integer) as n_units,
  '## 重點摘錄（原文選句，非 AI 改寫）' || chr(10) || chr(10) || coalesce(k.t, '可用文字不足，無法產生可靠摘要。')
  || coalesce(chr(10) || chr(10) || '## 數字／日期／條件線索（請核對原文）' || chr(10) || chr(10) || f.t, '') as summary,
  '# 來源對照' || chr(10) || chr(10) || coalesce(s.t, '') as sources
from d left join k on d.doc_id = k.doc_id left join f on d.doc_id = f.doc_id left join s on d.doc_id = s.doc_id""",
    "char_budget": _budget(36000),
    "char_budget_tight": _budget(2000),
    "chunk_pack": f"with recursive {V.PLAIN}, {V.UNITS}, {V.PACKED} select * from packed",
}
