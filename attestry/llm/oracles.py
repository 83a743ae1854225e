"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

PLAIN = r"[^\x20\x09-\x0D]+"
FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""

#: Weights and block as in queries.py. The schedule is the recursive walk over slots.
OP3 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) AS n FROM documents),
c AS (
  SELECT source, CASE source WHEN 'src0' THEN 6 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS w,
    ((count(*) + 15) // 16) AS blocks FROM documents GROUP BY 1),
q AS (SELECT *, ((blocks + w - 1) // w) AS periods FROM c),
cut AS (SELECT DISTINCT x FROM (SELECT 0 AS x UNION ALL SELECT periods - 1 FROM q UNION ALL SELECT periods FROM q)),
ph AS (
  SELECT lo, hi, row_number() OVER (ORDER BY lo) - 1 AS phase FROM (
    SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM cut) WHERE hi IS NOT NULL),
sh AS (
  SELECT phase, lo, hi, source, greatest(0, least(w, blocks - lo * w)) AS share FROM ph CROSS JOIN q),
len AS (SELECT phase, any_value(lo) AS lo, any_value(hi) AS hi, sum(share)::BIGINT AS length FROM sh GROUP BY phase),
base AS (
  SELECT *, coalesce(sum(length * (hi - lo)) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_slot FROM len),
seat AS (
  SELECT s.phase, length, list(struct_pack(source := source, share := share) ORDER BY source) AS seats
  FROM sh s JOIN len USING (phase) WHERE share > 0 GROUP BY s.phase, length),
walk(phase, length, seats, slot, given, pick) AS (
  SELECT phase, length, seats, -1::BIGINT, list_transform(seats, lambda x: 0::BIGINT), NULL::BIGINT FROM seat
  UNION ALL
  SELECT phase, length, seats, slot + 1, list_transform(given, lambda g, k: g + CASE WHEN k = p THEN 1 ELSE 0 END), p FROM (
    SELECT *, list_min(list_filter(list_transform(seats, lambda x, k: CASE
        WHEN given[k] < x.share AND (given[k] * length) // x.share <= slot + 1
        THEN struct_pack(due := ((given[k] + 1) * length + x.share - 1) // x.share, k := k) END), lambda x: x IS NOT NULL)).k AS p
    FROM walk WHERE slot + 1 < length)),
plan AS (
  SELECT phase, slot, seats[pick].source AS source,
    row_number() OVER (PARTITION BY phase, seats[pick].source ORDER BY slot) - 1 AS nth FROM walk WHERE slot >= 0),
t AS (SELECT d.doc_id, d.source, d.n // 16 AS block, d.n % 16 AS in_block, q.w FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT t.doc_id, t.source, t.block, t.in_block, (base_slot + (t.block // t.w - lo) * length + plan.slot)::BIGINT AS slot
FROM t JOIN base ON t.block // t.w >= lo AND t.block // t.w < hi
JOIN plan ON plan.phase = base.phase AND plan.source IS NOT DISTINCT FROM t.source AND plan.nth = t.block % t.w
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    row_number() OVER () AS k FROM documents),
g AS (
  SELECT k, i, array_to_string(w[i:i+7], ' ') AS s FROM (
    SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT k, s FROM g GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT g.k, unnest(range(i, i + 8)) AS p FROM g JOIN r USING (k, s)) GROUP BY k),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN c USING (k)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 100000 THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed FROM f
"""

OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, '{FOLDED}') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({LOWER}, '{FOLDED}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (
  SELECT k, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM (
    SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, s)),
p AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT k, i, n FROM h)) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN t USING (k)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
o AS (SELECT doc_id, list(p ORDER BY p) AS gone FROM x GROUP BY 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
z AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN x ON x.doc_id = u.doc_id AND x.p = u.p WHERE x.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN z USING (doc_id)
"""

#: The template's control strings are those of chat_format.CHAT; a text is escaped by a backslash after the head of each.
OP12 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 1, 'user', '</s>[INST] ok [/INST]'), (-7, 2, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, '<s>' || regexp_replace(regexp_replace(role, '(<)(\\*)(s>|/s>|unk>|\|endoftext\|>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')
    || CASE WHEN role = 'assistant' THEN '[/INST]' ELSE '[INST]' END
    || regexp_replace(regexp_replace(text, '(<)(\\*)(s>|/s>|unk>|\|endoftext\|>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g') || '</s>' AS shown
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP13 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{FOLDED}') AS w FROM documents),
lengths AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*)::BIGINT AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{FOLDED}')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus),
s AS (SELECT item_id, r, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lengths USING (r), corpus GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s JOIN lengths USING (r) WHERE score > 0) WHERE rank <= 20
"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op3_mixing": OP3,
    "op5_quality_rules": OP5,
    "op7_benchmark_decontamination": OP7,
    "op8_substring_dedup": OP8,
    "op12_chat_formatting": OP12,
    "op13_ranked_search": OP13,
}
