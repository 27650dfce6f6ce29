"""DuckDB SQL for the pipeline operators that SQL can express."""

from __future__ import annotations

from textrisk.llm.licenses import COSINE, NOTICE_SHARE, TEMPLATES
from textrisk.llm.line_dedup import MIN_PAGES, RATIO
from textrisk.llm.mix import BLOCK_WORDS, MAX_REPEATS, SEED, SHARD_ROWS, WEIGHTS
from textrisk.llm.search import IMPACT_SCALE, NORM_BASE, NORM_FACTOR, NORM_SLOPE, TF_SCALE, TOP_K, WEIGHT_SCALE

_LINE_DEDUP = f"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM pages
),
bare AS (SELECT r, host, i, line, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines),
totals AS (SELECT host, count(*) AS n_total FROM pages GROUP BY host),
boilerplate AS (
  SELECT host, key FROM bare JOIN totals USING (host) WHERE key <> ''
  GROUP BY host, key, n_total
  HAVING count(DISTINCT r) >= {MIN_PAGES} AND count(DISTINCT r) > n_total * {RATIO}
),
kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.key IS NULL) AS text,
         count(b.key) AS n_dropped
  FROM bare LEFT JOIN boilerplate b USING (host, key) GROUP BY r
)
SELECT doc_id, CASE WHEN pages.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       cast(coalesce(n_dropped, 0) AS int) AS n_dropped
FROM pages LEFT JOIN kept USING (r)
"""

_CUE = "(?i)licen[cs]|copyright|permission|redistribut|public domain|spdx"
_TERMS_OF = "regexp_extract_all(lower(line), '[a-z0-9]+(?:\\.[0-9]+)*')"
_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{line}')" for i, (name, line) in enumerate(TEMPLATES))

_LICENSES = f"""
WITH files AS (
  SELECT coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || doc_id || '.txt' AS file, text FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT * FROM (SELECT file, unnest(string_split(text, chr(10))) AS line FROM files) WHERE regexp_matches(line, '{_CUE}')),
templates(template, license, line) AS (VALUES {_TEMPLATE_ROWS}),
seen AS (SELECT line, count(*) AS n FROM lines GROUP BY line),
line_tf AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest({_TERMS_OF}) AS term FROM seen) GROUP BY ALL),
template_tf AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_TERMS_OF}) AS term FROM templates) GROUP BY ALL),
frequency AS (
  SELECT term, sum(n) AS df FROM (SELECT term, n FROM line_tf UNION ALL SELECT term, 1 FROM template_tf) GROUP BY term),
idf AS (
  SELECT term, ln(((SELECT count(*) FROM lines) + {len(TEMPLATES)} + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0 AS idf FROM frequency),
line_w AS (SELECT line, term, tf * idf AS w FROM line_tf JOIN idf USING (term)),
template_w AS (SELECT template, license, term, tf * idf AS w FROM template_tf JOIN idf USING (term)),
line_norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM line_w GROUP BY line),
template_norm AS (SELECT template, sqrt(sum(w * w)) AS norm FROM template_w GROUP BY template),
dots AS (
  SELECT l.line, t.template, t.license, sum(l.w * t.w) AS dot FROM line_w l JOIN template_w t USING (term) GROUP BY ALL),
cosines AS (
  SELECT d.line, license, round(dot / (l.norm * t.norm), 9) AS cosine
  FROM dots d JOIN line_norm l USING (line) JOIN template_norm t USING (template)),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY cosine DESC, license) AS place FROM cosines)
  WHERE place = 1 AND cosine >= {COSINE}),
found AS (SELECT file, length(line) AS n, license, cosine FROM lines JOIN best USING (line)),
own AS (
  SELECT * FROM (
    SELECT file, license, cosine, sum(n) OVER (PARTITION BY file) AS in_notices,
      row_number() OVER (PARTITION BY file ORDER BY cosine DESC, license) AS place FROM found) WHERE place = 1),
judged AS (
  SELECT f.file, f.directory, license, cosine, in_notices, n_chars FROM (
    SELECT file, regexp_extract(file, '^(.*)/[^/]*$', 1) AS directory, sum(coalesce(length(text), 0)) AS n_chars FROM files GROUP BY ALL) f
  LEFT JOIN own USING (file)),
holders AS (
  SELECT * FROM (
    SELECT directory AS holder, license AS inherited, cosine AS inherited_cosine,
      row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, license) AS place
    FROM judged WHERE license IS NOT NULL AND in_notices >= n_chars * {NOTICE_SHARE}) WHERE place = 1),
above AS (
  SELECT directory, depth, array_to_string(string_split(directory, '/')[1:depth], '/') AS holder
  FROM (SELECT directory, unnest(range(0, len(string_split(directory, '/')) + 1)) AS depth FROM (SELECT DISTINCT directory FROM judged))),
nearest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY directory ORDER BY depth DESC) AS nth FROM above JOIN holders USING (holder)) WHERE nth = 1)
SELECT file AS path, coalesce(license, inherited) AS license,
  round(CASE WHEN license IS NOT NULL THEN cosine ELSE inherited_cosine END, 6) AS cosine,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN license IS NOT NULL THEN directory ELSE holder END AS from_directory
FROM judged LEFT JOIN nearest USING (directory)
"""

# Every quotient of every unit is made here, where the operator makes only those near the last seat.
_MIX = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM rows GROUP BY source),
weighted AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid,
         [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
         (source_size * {MAX_REPEATS})::DOUBLE AS cap
  FROM per_source),
steps AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS all_w,
         sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS caps,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)::DOUBLE AS ws,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos
  FROM weighted),
levels AS (SELECT *, (total - (caps - cap)) / (all_w - ws + weight) AS level_before FROM steps),
first_fit AS (SELECT min(pos) AS first_fit FROM levels WHERE level_before <= cap / weight),
aimed AS (
  SELECT l.*, CASE WHEN total = 0 THEN 0.0 WHEN pos < first_fit THEN cap
                   ELSE weight * (SELECT level_before FROM levels, first_fit WHERE pos = first_fit) END AS target,
         ((sum(source_size) OVER () + {BLOCK_WORDS // 2}) // {BLOCK_WORDS})::BIGINT AS n_blocks
  FROM levels l, first_fit),
source_q AS (
  SELECT sid, target / (2 * k + 1) AS q, k, n_blocks
  FROM (SELECT sid, target, n_blocks, unnest(generate_series(0, n_blocks - 1)) AS k FROM aimed WHERE target > 0)),
source_seats AS (
  SELECT sid, count(*) AS seats FROM (
    SELECT *, row_number() OVER (ORDER BY q DESC, sid, k) AS place FROM source_q) WHERE place <= n_blocks GROUP BY sid),
quotas AS (
  SELECT a.source, a.sid, a.source_size, a.target,
         least(coalesce(seats, 0) * {BLOCK_WORDS}, a.source_size * {MAX_REPEATS})::BIGINT AS source_words,
         ceil(a.n_rows / {SHARD_ROWS})::BIGINT AS n_shards
  FROM aimed a LEFT JOIN source_seats USING (sid)),
placed AS (
  SELECT r.*, q.sid, q.source_size, q.target, q.source_words,
         ('0x' || substr(md5(concat_ws(':', {SEED}, r.doc_id)), 1, 8))::BIGINT % q.n_shards AS shard,
         md5(concat_ws(':', {SEED}, q.sid, r.doc_id)) AS key
  FROM rows r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT sid, shard, sum(size)::BIGINT AS shard_size, any_value(source_words) AS source_words FROM placed GROUP BY ALL),
shard_q AS (
  SELECT sid, shard, shard_size / (2 * k + 1)::DOUBLE AS q, k, source_words
  FROM (SELECT *, unnest(generate_series(0, source_words - 1)) AS k FROM shards WHERE shard_size > 0)),
shard_seats AS (
  SELECT sid, shard, count(*) AS words FROM (
    SELECT *, row_number() OVER (PARTITION BY sid ORDER BY q DESC, shard, k) AS place FROM shard_q)
  WHERE place <= source_words GROUP BY ALL),
shard_quota AS (
  SELECT s.sid, s.shard, s.shard_size, least(coalesce(words, 0), s.shard_size * {MAX_REPEATS}) AS words
  FROM shards s LEFT JOIN shard_seats USING (sid, shard)),
passes AS (
  SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes FROM shard_quota),
rests AS (SELECT *, words - passes * shard_size AS rest FROM passes),
blocks AS (
  SELECT sid, shard, rest, block, least({BLOCK_WORDS}, shard_size - block * {BLOCK_WORDS}) AS len
  FROM (SELECT *, unnest(generate_series(0, (shard_size - 1) // {BLOCK_WORDS})) AS block FROM rests WHERE rest > 0)),
chosen AS (
  SELECT * FROM (
    SELECT sid, shard, block, least(len, rest - coalesce(sum(len) OVER (
             PARTITION BY sid, shard ORDER BY md5(concat_ws(':', {SEED}, sid, shard, block)), block
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS take
    FROM blocks) WHERE take > 0),
located AS (
  SELECT p.*, coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY key, doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed p),
extras AS (
  SELECT l.r, sum(greatest(0, least(l.start + l.size, c.block * {BLOCK_WORDS} + c.take)
                               - greatest(l.start, c.block * {BLOCK_WORDS}))) AS extra
  FROM located l JOIN chosen c ON l.sid = c.sid AND l.shard = c.shard
   AND c.block BETWEEN l.start // {BLOCK_WORDS} AND (l.start + l.size - 1) // {BLOCK_WORDS}
  WHERE l.size > 0 GROUP BY l.r)
SELECT l.doc_id, l.source, l.size, l.source_size, l.target,
       (rs.passes * l.size + coalesce(o.extra, 0))::BIGINT AS taken
FROM located l JOIN rests rs USING (sid, shard) LEFT JOIN extras o USING (r)
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"list_transform(regexp_extract_all(coalesce({{0}}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t, '{_UPPER}', '{_UPPER.lower()}'))"

# Every document is scored for every item that shares a term with it.
_SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS terms FROM documents),
sized AS (SELECT *, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
postings AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (
  SELECT term, floor({WEIGHT_SCALE} * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, big_n),
items AS (SELECT row_number() OVER () AS ir, item_id, {_TERMS.format("text")} AS terms FROM benchmark),
item_terms AS (SELECT ir, item_id, unnest(list_distinct(terms)) AS term FROM items),
scores AS (
  SELECT ir, item_id, r, doc_id,
         sum(w * (({IMPACT_SCALE} * tf) // ({TF_SCALE} * tf + {NORM_FACTOR} * ({NORM_BASE - NORM_SLOPE} + ({NORM_SLOPE} * n * big_n) // big_l))))::BIGINT AS score
  FROM item_terms JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ir ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {TOP_K}
"""

ORACLES = {"op1_line_dedup": _LINE_DEDUP, "op6_licenses": _LICENSES, "op11_mix": _MIX, "op13_search": _SEARCH}
