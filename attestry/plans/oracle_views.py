"""The same views and shared steps in DuckDB SQL, as common table expressions."""

D = """d as (
  select doc_id, lang, source,
    case doc_id % 5 when 0 then '=1+1' when 1 then '+x' when 2 then '-x' when 3 then '@x' else 'plain' end as title,
    'https://example.com/doc/' || doc_id as url,
    text
      || case when doc_id % 3 = 0 then chr(10) || 'Fee $' || doc_id
           || ' before the deadline 2026-10-01, see [terms](https://example.com/' || doc_id || ').' else '' end
      || case when doc_id % 4 = 0 then chr(10) || '[nav](https://example.com/)' else '' end as text
  from documents)"""

PLAIN = """d as (
  select doc_id, source, 'https://example.com/doc/' || doc_id as url, text from documents)"""

UNITS = r"""lines as (
  select doc_id, url, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as ln
  from d),
marked as (
  select doc_id, url, ln,
    string_split(regexp_replace(regexp_replace(line, '([。！？])', '\1' || chr(1), 'g'),
      '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as parts
  from lines
  where not regexp_full_match(trim(line, ' -*#' || chr(9)), '\[[^\]]+\]\([^)]+\)')),
sentences as (
  select doc_id, url, ln, unnest(parts) as part, generate_subscripts(parts, 1) as sn from marked),
stripped as (
  select doc_id, url, ln, sn, trim(part, ' #*' || chr(9) || chr(13)) as s from sentences),
firsts as (
  select doc_id, url, ln, sn, regexp_replace(s, '\[([^\[\]]+)\]\(https?://[^)]+\)', '\1', 'g') as s
  from stripped where length(s) >= 4
  qualify row_number() over (partition by doc_id, s order by ln, sn) = 1),
lettered as (
  select * from firsts where length(regexp_replace(s, '[^A-Za-z一-鿿]', '', 'g')) >= 4),
pieces as (
  select doc_id, url, ln, sn, k, substring(s, k * 600 + 1, 600) as text
  from (select *, unnest(range(0, (length(s) - 1) // 600 + 1)) as k from lettered)),
units as (
  select doc_id, cast(row_number() over (partition by doc_id order by ln, sn, k) as integer) as unit_no, text, url
  from pieces),
u as (
  select doc_id, unit_no, 'S' || case when unit_no < 1000 then lpad(cast(unit_no as varchar), 3, '0')
    else cast(unit_no as varchar) end as unit_id, text, url from units)"""

TOKENS = r"""tok as (
  select doc_id, unit_no, unit_id, text, url,
    regexp_extract_all(lower(text), '[a-z]{3,}|[一-鿿]{2}') as tokens from u),
dtok as (select doc_id, unit_no, unnest(list_distinct(tokens)) as token from tok),
df as (select doc_id, token, count(*) as df from dtok group by 1, 2),
sums as (select t.doc_id, t.unit_no, sum(df.df) as s
  from dtok t join df on t.doc_id = df.doc_id and t.token = df.token group by 1, 2),
scored as (
  select tok.*, coalesce(s, 0) / greatest(len(tokens), 1)
    + case when regexp_matches(tok.text, '\d|重要|建議|注意|結論|截止|步驟') then 1.0 else 0.0 end as score
  from tok left join sums on tok.doc_id = sums.doc_id and tok.unit_no = sums.unit_no),
ranked as (
  select *, row_number() over (partition by doc_id order by score desc, unit_no) as rank from scored),
facts as (
  select * from u where regexp_matches(text,
    '(?i)\b\d{4}[-/]\d{1,2}|\d+(?:\.\d+)?\s*(?:%|元|萬|億|美元|天|小時)|截止|報名|deadline|price|\$\d')
  qualify row_number() over (partition by doc_id order by unit_no) <= 8)"""

LOG = """log as (
  select 'https://example.com/u/' || user_id as url, user_id % 10 as run_id, event_id as attempt,
    case when event_type in ('click', 'view') then 200 when event_type = 'signup' then 404
      when event_type = 'purchase' then 429 when value > 10 then 503 end as status,
    event_type in ('click', 'view') as ok,
    case when event_type not in ('click', 'view', 'signup', 'purchase') and not value > 10 then 'timed out' else '' end as error_text
  from events),
last as (
  select *, count(*) over (partition by url) as attempts from log
  qualify row_number() over (partition by url order by attempt desc) = 1),
outcome as (
  select run_id, url, attempts, status,
    ok and (status is null or status < 400) as success,
    case when ok then '' when error_text <> '' then error_text else 'HTTP ' || status end as error,
    not ok and (coalesce(status in (408, 500, 502, 503, 504), false) or status is null) as transient
  from last)"""

SAVED = D + """,
saved as (
  select d.doc_id, source, url, title, text as markdown, coalesce(toxic, 0) <> 1 as success,
    case when coalesce(toxic, 0) = 1 then 'HTTP 404' else '' end as error, '' as summary,
    case when quality is null then '尚未完成' when quality = 0 then '基本摘錄' else 'openai' end as summary_mode
  from d left join labels on d.doc_id = labels.doc_id)"""

C = """c as (
  select conv_id as video_id, turn as pos, lpad(cast(conv_id as varchar), 11, '0') as code,
    turn * 17 + (conv_id % 5) * 0.25 as start_s, cast(4 + turn % 3 as double) as duration_s, text
  from conversations)"""

S = C + """,
s as (
  select video_id, pos * 1000000 + k as pos, cast(pos * 17 + k * 1.5 as double) as start_s, duration_s,
    substring(text, cast(k * 30 + 1 as integer), 30) as text
  from (select *, unnest(range(0, (length(text) - 1) // 30 + 1)) as k from c)
  where regexp_matches(substring(text, cast(k * 30 + 1 as integer), 30), '\\S'))"""

LINES = C + """,
line as (
  select video_id, pos, sec as seconds, '[' || lpad(cast(sec // 3600 as varchar), 2, '0') || ':'
      || lpad(cast(sec // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(sec % 60 as varchar), 2, '0')
      || '](https://www.youtube.com/watch?v=' || code || '&t=' || sec || 's) ' || t as line,
    t as text, '[' || lpad(cast(sec // 3600 as varchar), 2, '0') || ':'
      || lpad(cast(sec // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(sec % 60 as varchar), 2, '0') as stamp_open,
    'https://www.youtube.com/watch?v=' || code || '&t=' || sec || 's' as url
  from (select *, cast(floor(greatest(start_s, 0)) as bigint) as sec, trim(replace(text, chr(10), ' ')) as t from c)
  where t <> '')"""

BLOCKS = LINES + """,
cap as (
  select video_id, row_number() over (partition by video_id order by pos) as n,
    substring(stamp_open, 2) as time, url, seconds, text from line
  where lower(trim(text)) not in ('[music]', '[applause]', '(笑', '（笑')),
bwalk as (
  select video_id, n, 1 as block, seconds as begin_s, cast(length(text) as bigint) as size from cap where n = 1
  union all
  select video_id, next_n, case when o then block + 1 else block end,
    case when o then seconds else begin_s end, case when o then len else size + len + 1 end
  from (select w.video_id, x.n as next_n, w.block, w.begin_s, w.size, x.seconds, length(x.text) as len,
      x.seconds - w.begin_s >= 35 or w.size + length(x.text) > 1000 as o
    from bwalk w join cap x on x.video_id = w.video_id and x.n = w.n + 1)),
b as (
  select w.video_id, cast(block as integer) as unit_no,
    'S' || case when block < 1000 then lpad(cast(block as varchar), 3, '0') else cast(block as varchar) end as unit_id,
    string_agg(text, ' ' order by cap.n) as text, min_by(url, cap.n) as url, min_by(time, cap.n) as time,
    min_by(seconds, cap.n) as seconds, cast(count(*) as integer) as n_captions
  from bwalk w join cap on cap.video_id = w.video_id and cap.n = w.n group by w.video_id, block)"""

CHUNKS = BLOCKS + """,
cwalk as (
  select video_id, unit_no, 1 as chunk, seconds as begin_s, cast(length(text) as bigint) as size from b where unit_no = 1
  union all
  select video_id, next_no, case when o then chunk + 1 else chunk end,
    case when o then seconds else begin_s end, case when o then len else size + len end
  from (select w.video_id, x.unit_no as next_no, w.chunk, w.begin_s, w.size, x.seconds, length(x.text) as len,
      w.size + length(x.text) > 1200 or x.seconds - w.begin_s >= 105 as o
    from cwalk w join b x on x.video_id = w.video_id and x.unit_no = w.unit_no + 1)),
chunked as (
  select b.*, cast(w.chunk as integer) as chunk_no
  from b join cwalk w on w.video_id = b.video_id and w.unit_no = b.unit_no)"""

FRAMES = """fr as (
  select conv_id as video_id, 'F' || case when turn < 1000 then lpad(cast(turn as varchar), 3, '0') else cast(turn as varchar) end as frame_id, turn as pos,
    lpad(cast(conv_id as varchar), 11, '0') as code, turn * 17 + 3 as seconds,
    cast(case when conv_id % 4 <> 0 then turn * 17 + 3.04 end as double) as decoded_s,
    case conv_id % 3 when 0 then text when 1 then 'Q' || turn || ' ' || turn * 5 else '訂閱 活動 ' || turn end as ocr,
    case when conv_id % 7 = 0 then null when conv_id % 2 = 0 then 'hardware-verified' else 'software-fallback' end as decoder_status,
    'frames/F' || case when turn < 1000 then lpad(cast(turn as varchar), 3, '0') else cast(turn as varchar) end || '.jpg' as file
  from conversations),
hint as (select video_id, frame_id,
  '位置配對：Q' || pos || ' ↔ ' || pos * 5 || '、R' || pos || ' ↔ ' || pos as hints from fr where video_id % 3 = 1)"""

CONTEXT = S + ", " + FRAMES + """,
ctx as (
  select f.video_id, f.frame_id, coalesce(decoded_s, cast(seconds as double)) as at_s, s.pos, s.start_s, s.duration_s,
    trim(replace(s.text, chr(10), ' ')) as caption, greatest(s.start_s - coalesce(decoded_s, seconds),
      coalesce(decoded_s, seconds) - s.start_s - s.duration_s, 0.0::double) as distance
  from fr f join s on s.video_id = f.video_id),
near as (
  select *, cast(row_number() over (partition by video_id, frame_id order by distance, pos) as integer) as rank
  from ctx where distance <= 8 qualify rank <= 10)"""

OCR = """ocr_raw as (
  select *, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as n
  from lineitem),
ocr_all as (
  select l_orderkey as frame_id, n * 3 as pos, cast(cast(l_quantity as integer) as varchar) as text,
    cast(l_partkey % 1280 as double) as x, cast(l_suppkey % 200 as double) as y, l_discount * 10 as confidence from ocr_raw
  union all select l_orderkey, n * 3 + 1, 'Q' || n, l_partkey % 1280 + l_suppkey % 60 - 30, l_suppkey % 200 + 200, 0.9 from ocr_raw
  union all select l_orderkey, n * 3 + 2, 'STEP' || n, n * 150, 650 + n * 10, 0.8 from ocr_raw),
ocr as (
  select frame_id, cast(row_number() over (partition by frame_id order by pos) as integer) as n,
    cast(pos as integer) as pos, text, round(confidence, 3) as confidence, x, y
  from ocr_all where confidence >= 0.45)"""

CANDIDATES = """span as (select user_id, min(ts) as lo, max(ts) as hi from events group by 1),
cand as (
  select e.user_id as video_id, event_id as pos, (epoch_us(ts) - epoch_us(lo)) / 1e9::double as at_s, value as score,
    (epoch_us(hi) - epoch_us(lo)) / 1e9::double as duration_s
  from events e join span s on s.user_id = e.user_id)"""

MATCH = CONTEXT + r""",
ocrline as (
  select video_id, frame_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as ocr_pos
  from (select video_id, frame_id, string_split(ocr, chr(10)) as l from fr)),
pair as (
  select n.video_id, n.frame_id, n.rank, cast(o.ocr_pos as integer) as ocr_pos, o.text as ocr, n.caption, n.start_s,
    replace(lower(regexp_replace(o.text, '\s+', '', 'g')), 'ß', 'ss') as a,
    replace(lower(regexp_replace(n.caption, '\s+', '', 'g')), 'ß', 'ss') as b
  from near n join ocrline o on o.video_id = n.video_id and o.frame_id = n.frame_id where o.text <> ''),
ab as (select distinct a, b from pair),
piece as (
  select a, b, substring(b, cast(i as integer), cast(n as integer)) as p
  from (select a, b, i, unnest(range(1, length(b) - i + 2)) as n
    from (select a, b, unnest(range(1, length(b) + 1)) as i from ab))
  where contains(a, substring(b, cast(i as integer), cast(n as integer)))),
common as (
  select a, b, p as shared from piece
  qualify row_number() over (partition by a, b order by length(p) desc, instr(a, p)) = 1),
sharedpair as (
  select pair.*, coalesce(c.shared, '') as shared from pair left join common c on c.a = pair.a and c.b = pair.b),
bestpair as (
  select * from sharedpair where length(shared) >= 4 or (length(shared) >= 2 and regexp_matches(shared, '\d'))
  qualify row_number() over (partition by video_id, frame_id order by length(shared) desc, ocr_pos, rank) = 1),
matched as (
  select f.video_id, f.frame_id, f.pos, coalesce(m.shared, '') as shared,
    case when m.frame_id is not null then m.ocr else coalesce(o.t, '') end as ocr,
    coalesce(m.caption, n.caption) as caption, coalesce(m.start_s, n.start_s) as caption_s,
    case when m.frame_id is not null then 'text-overlap' else 'temporal-only' end as association
  from fr f
  left join bestpair m on m.video_id = f.video_id and m.frame_id = f.frame_id
  left join near n on n.video_id = f.video_id and n.frame_id = f.frame_id and n.rank = 1
  left join (select video_id, frame_id, string_agg(text, ' ' order by ocr_pos) as t from ocrline where text <> '' group by 1, 2) o
    on o.video_id = f.video_id and o.frame_id = f.frame_id
  where m.frame_id is not null or n.frame_id is not null)"""

EVIDENCE = MATCH + r""",
clean_s as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean from s),
placed as (
  select m.*, f.seconds, f.decoded_s, sha256(f.ocr) as frame_sha256, coalesce(f.decoder_status, 'unknown') as decoder_status,
    s.start_s as near_s, s.duration_s as near_d
  from matched m join fr f on f.video_id = m.video_id and f.frame_id = m.frame_id
  left join clean_s s on s.video_id = m.video_id and s.clean = trim(regexp_replace(m.caption, '\s+', ' ', 'g'))
  qualify row_number() over (partition by m.video_id, m.frame_id order by abs(s.start_s - m.caption_s), s.pos) = 1),
record as (
  select video_id, 'E' || lpad(cast(row_number() over (partition by video_id order by pos) as varchar), 3, '0') as evidence_id,
    frame_id, frame_sha256, seconds, decoded_s, decoder_status, 'Frame ' || frame_id as title,
    'The frame shows text next to the words: ' || caption as summary, caption as caption_text,
    coalesce(near_s, caption_s) as caption_start, near_d as caption_duration,
    case when near_s is not null then 'source-timestamp' else 'markdown-whole-seconds' end as caption_precision,
    ocr, shared as shared_text, association,
    case when association = 'text-overlap' then 'openai' end as provider, 'reader-' || video_id % 2 as model
  from placed)"""

PACKED = """run as (select *, length(unit_id) + length(text) + 3 as n,
    sum(length(unit_id) + length(text) + 3) over (partition by doc_id order by unit_no) as cum from u),
fit as (select * from run where cum <= 36000),
walk as (
  select doc_id, unit_no, 1 as chunk_no, n as size from fit where unit_no = 1
  union all
  select f.doc_id, f.unit_no, case when w.size + f.n > 4500 then w.chunk_no + 1 else w.chunk_no end,
    case when w.size + f.n > 4500 then f.n else w.size + f.n end
  from walk w join fit f on f.doc_id = w.doc_id and f.unit_no = w.unit_no + 1),
packed as (
  select w.doc_id, chunk_no, cast(count(*) as integer) as n_units, min_by(unit_id, f.unit_no) as first_unit,
    string_agg('[' || unit_id || '] ' || text, chr(10) order by f.unit_no) as chunk
  from walk w join fit f on f.doc_id = w.doc_id and f.unit_no = w.unit_no group by 1, 2)"""

REPLIES = """reply as (
  select doc_id, ['ollama', 'openai', 'gemini'][doc_id % 3 + 1] as provider, doc_id % 11 = 0 as bad,
    case when doc_id % 13 = 0 then [] when doc_id % 5 = 0 then ['S001', 'S999'] else ['S001'] end as refs,
    'Claim about document ' || doc_id as claim,
    '{"text":"Claim about document ' || doc_id || '","sources":'
      || case when doc_id % 13 = 0 then '[]' when doc_id % 5 = 0 then '["S001","S999"]' else '["S001"]' end || '}' as item
  from documents),
decoded as (
  select *, case when bad then null else '{"overview":' || item || ',"points":[' || item
    || '],"facts":[],"uncertainties":"none"}' end as answer from reply),
draft as (
  select doc_id, refs, '## 一句話摘要' || chr(10) || chr(10) || claim || ' ' || m || chr(10) || chr(10) || '## 重點'
    || chr(10) || chr(10) || '- ' || claim || ' ' || m || chr(10) || chr(10) || '## 重要數字／日期／條件'
    || chr(10) || chr(10) || '未提供' || chr(10) || chr(10) || '## 待確認事項' || chr(10) || chr(10) || 'none' as draft
  from (select *, array_to_string(list_transform(refs, lambda r: '[' || r || ']'), ' ') as m from decoded where not bad))"""

EXCERPTS = SAVED + ", " + UNITS + """,
plan as (
  select doc_id, source, title, url, row_number() over (partition by source order by doc_id) as document,
    count(*) over (partition by source) as n_docs
  from saved where success and regexp_matches(markdown, '\\S')),
room as (select *, greatest(80, 16000 // n_docs) as allowance from plan where n_docs >= 2),
cutting as (
  select r.source, r.document, r.doc_id, r.title, r.url, r.allowance, u.unit_no, u.text,
    coalesce(sum(length(u.text)) over (partition by r.doc_id order by u.unit_no rows between unbounded preceding and 1 preceding), 0) as prev
  from room r join u on u.doc_id = r.doc_id),
ex as (
  select source, document, 'S' || lpad(cast(document as varchar), 3, '0') as unit_id, doc_id, url,
    '文件 ' || document || '（' || title || '）：'
      || string_agg(substring(text, 1, cast(allowance - prev as integer)), chr(10) order by unit_no) as text
  from cutting where prev < allowance group by source, document, doc_id, url, title)"""

ANSWERS = EXCERPTS + """,
ans as (
  select doc_id as answer_id, source, document, unit_id,
    case when document % 5 = 0 then ['S99999'] when document % 2 = 0
      then [unit_id, 'S' || lpad(cast(document - 1 as varchar), 3, '0')] else [unit_id, unit_id] end as refs,
    case when doc_id % 17 = 0 then 'short' else 'Both sources state point ' || document end as text,
    case when doc_id % 19 = 0 then 6 else 2 end as singles from ex),
refd as (
  select a.answer_id, count(*) as n, count(e.document) as known, count(distinct e.document) as docs
  from (select answer_id, source, unnest(refs) as ref from ans) a
  left join ex e on e.source = a.source and e.unit_id = a.ref group by 1),
judged as (
  select a.*, case when length(text) < 8 then 'bad text' when known < n then 'unknown source'
    when docs < 2 then 'needs two documents' when singles > 5 then 'bad section' end as rule
  from ans a join refd r on r.answer_id = a.answer_id)"""

NOTES = CHUNKS + r""",
held as (
  select *, row_number() over (partition by video_id, chunk_no order by unit_no) as n,
    replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss') as piece,
    lead(text) over (partition by video_id, chunk_no order by unit_no) as following from chunked),
off as (
  select *, sum(length(piece)) over (partition by video_id, chunk_no order by unit_no) - length(piece) as lo from held),
whole as (select video_id, chunk_no, string_agg(piece, '' order by unit_no) as joined from off group by 1, 2),
note as (
  select video_id, chunk_no, n, unit_no, unit_id,
    case when unit_no % 6 = 5 then 'T' else 'Turn ' || unit_no end as title,
    case when unit_no % 7 = 3 then '影片主要介紹各種技巧' else 'The speaker states: ' || text end as text,
    case when video_id % 3 = 0 then 'not in the source at all'
      when unit_no % 3 = 1 and following is not null then text || ' ' || following else text end as evidence
  from off),
folded as (
  select *, replace(lower(regexp_replace(evidence, '\s+', '', 'g')), 'ß', 'ss') as needle from note),
spot as (
  select f.*, strpos(w.joined, f.needle) - 1 as at from folded f
  join whole w on w.video_id = f.video_id and w.chunk_no = f.chunk_no),
ref as (
  select s.video_id, s.chunk_no, s.n, list(o.unit_id order by o.unit_no) as refs,
    min(o.seconds) as at_s, string_agg('[' || o.time || '](' || o.url || ')', ' ' order by o.unit_no) as links
  from spot s join off o on o.video_id = s.video_id and o.chunk_no = s.chunk_no
    and s.at >= 0 and o.lo < s.at + length(s.needle) and o.lo + length(o.piece) > s.at group by 1, 2, 3),
located as (
  select s.*, r.refs, r.at_s, r.links from spot s
  left join ref r on r.video_id = s.video_id and r.chunk_no = s.chunk_no and r.n = s.n),
rules as (
  select *, length(trim(text)) between 8 and 900 and not regexp_matches(text, '^影片主要介紹') and unit_no % 4 <> 0
    and length(trim(evidence)) between 6 and 1200 and refs is not null as good, length(title) between 2 and 80 as titled
  from located),
val as (
  select video_id, chunk_no, count(*) filter (where good and titled) as n_outline, count(*) filter (where good) as n_points,
    2 * count(*) - count(*) filter (where good and titled) - count(*) filter (where good) as dropped
  from rules group by 1, 2)"""

GATED = NOTES + """,
verdict as (
  select video_id, chunk_no, n, (video_id + chunk_no + n) % 5 <> 0 as supported from rules
  where good and not ((video_id + chunk_no) % 11 = 0 and n = 2)),
lack as (
  select r.video_id, r.chunk_no, bool_or(v.supported is null) as failed from rules r
  left join verdict v on v.video_id = r.video_id and v.chunk_no = r.chunk_no and v.n = r.n where good group by 1, 2),
gate as (
  select r.video_id, r.chunk_no, r.n, case when coalesce(v.supported, false) then title else '字幕原句' end as title,
    case when coalesce(v.supported, false) then text else '字幕原句：「' || evidence || '」' end as text,
    evidence, refs, at_s, links, not coalesce(v.supported, false) as extractive, l.failed
  from rules r join lack l on l.video_id = r.video_id and l.chunk_no = r.chunk_no
  left join verdict v on v.video_id = r.video_id and v.chunk_no = r.chunk_no and v.n = r.n where good),
gated as (
  select *, 'points' as section from gate union all select *, 'outline' from gate where not extractive)"""

REPORTS = r"""h as (
  select doc_id, '# Report ' || doc_id || e'\n\n## Findings\n\n- item ' || lang || e'\n\n> ' || source
    || e'\n\n![frame](frames/' || doc_id || e'.jpg)\n\n### Table\n\n|k|v|\n|---|---|\n|lang|' || lang
    || e'|\n\n[link](https://example.com/' || doc_id || e') tail\n\n### Text\n\n' || text as text from documents),
hl as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as ln
  from (select doc_id, string_split(text, chr(10)) as l from h)),
hs as (
  select *, sum(case when starts_with(line, '## ') or starts_with(line, '### ') then 1 else 0 end)
    over (partition by doc_id order by ln) as sec from hl),
sect as (
  select doc_id, sec, coalesce(max(trim(ltrim(line, '# '))) filter (where starts_with(line, '## ') or starts_with(line, '### ')), '摘要') as title,
    regexp_replace(coalesce(string_agg(line, chr(10) order by ln)
      filter (where not (starts_with(line, '## ') or starts_with(line, '### '))), ''), '^\s+|\s+$', '', 'g') as body
  from hs group by 1, 2),
section as (
  select doc_id, cast(row_number() over (partition by doc_id order by sec) as integer) as n, title, body
  from sect where body <> ''),
kinds as (
  select doc_id, ln, trim(line) as line, case when trim(line) = '' then 'blank'
    when regexp_full_match(trim(line), '!\[[^\]]*\]\([^)]+\)') then 'image' when starts_with(trim(line), '|') then 'table'
    when starts_with(trim(line), '### ') then 'h3' when starts_with(trim(line), '## ') then 'h2'
    when starts_with(trim(line), '# ') then 'h1' when starts_with(trim(line), '> ') then 'quote'
    when regexp_matches(trim(line), '^[-*] ') then 'bullet' else 'paragraph' end as kind from hl),
opened as (
  select *, kind = 'table' and regexp_matches(coalesce(lead(line) over (partition by doc_id order by ln), ''), '^\|?\s*:?-+') as opens,
    lag(kind) over (partition by doc_id order by ln) as before, lead(kind) over (partition by doc_id order by ln) as after
  from kinds),
grouped as (
  select *, sum(case when kind = before and kind = 'table' then 0
      when kind = 'paragraph' and before = 'paragraph' and not regexp_matches(line, '^(#{1,3} |[-*>] |!\[|\|)') then 0 else 1 end)
    over (partition by doc_id order by ln) as g from opened),
block as (
  select doc_id, g, case when arg_min(kind, ln) = 'table' and not arg_min(opens, ln) then 'paragraph' else arg_min(kind, ln) end as kind,
    case when arg_min(kind, ln) in ('h1', 'h2', 'h3') then regexp_replace(min_by(line, ln), '^#{1,3} ', '')
      when arg_min(kind, ln) in ('quote', 'bullet') then substring(min_by(line, ln), 3)
      when arg_min(kind, ln) = 'table' then string_agg(line, chr(10) order by ln)
      else string_agg(line, ' ' order by ln) end as content, cast(count(*) as integer) as lines
  from grouped group by 1, 2)"""
