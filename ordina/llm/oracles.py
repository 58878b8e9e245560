"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP3 = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, payload FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d),
x AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload, url,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM k),
h AS (SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || payload_bytes || chr(13) || chr(10) || chr(13) || chr(10) AS http FROM x),
r AS (SELECT *, encode(array_to_string(list_filter(['WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: <urn:x-page:' || coalesce(CAST(page_id AS VARCHAR), 'null') || '>', 'WARC-Date: 1970-01-01T00:00:00Z',
    'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7F]', '%20', 'g'), 'WARC-Payload-Digest: sha1:' || payload_digest,
    CASE WHEN record_type = 'revisit' THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
    CASE WHEN record_type = 'revisit' THEN 'WARC-Refers-To: <urn:x-page:' || refers_to || '>' END, 'Content-Type: application/http; msgtype=response',
    'Content-Length: ' || (octet_length(encode(http)) + CASE WHEN record_type = 'response' THEN payload_bytes ELSE 0 END), '', http], lambda y: y IS NOT NULL), chr(13) || chr(10))) AS head FROM h),
w AS (SELECT *, head || CASE WHEN record_type = 'response' THEN payload ELSE encode('') END || encode(chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM r)
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, CAST(octet_length(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256 FROM w
"""

OP4 = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM s JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT s.page_id, host, path, m.rule, coalesce(m.verdict,
  CASE WHEN host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({_WORDS}), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * n / weight AS ratio, row_number() OVER (ORDER BY 2.0::DOUBLE * n / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, n, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(weight * (SELECT arg_min(level, k) FROM l WHERE level <= ratio), 2.0::DOUBLE * n) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.n, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
  CAST((budget // greatest(n, 1)) * size + greatest(0, least(size, budget - (budget // greatest(n, 1)) * n - before)) AS BIGINT) AS taken
FROM p
"""

OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, row_number() OVER () AS row FROM d),
p(kind, rank, pattern) AS (VALUES
  ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'), ('weak_access', 3, '(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{8,}'),
  ('endpoint', 5, '(?:https?|wss?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:@/-]+')),
m AS (SELECT row, kind, rank, CASE kind WHEN 'assign' THEN regexp_extract_all(text, (SELECT pattern FROM p WHERE kind = 'assign')) WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+')
    WHEN 'hex' THEN regexp_extract_all(text, '[0-9a-f]+') WHEN 'weak_access' THEN regexp_extract_all(text, '(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{8,}') ELSE regexp_extract_all(text, (SELECT pattern FROM p WHERE kind = 'endpoint')) END AS hits,
  regexp_split_to_array(text, pattern) AS gaps FROM e, p),
x AS (SELECT row, kind, rank, unnest(hits) AS hit, unnest(list_slice(gaps, 1, len(hits))) AS gap, generate_subscripts(hits, 1) AS i FROM m WHERE len(hits) > 0),
y AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) AS stop, length(regexp_replace(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '')) AS value FROM x),
s AS (SELECT row, CASE WHEN kind = 'assign' AND value < 12 THEN 'weak_secret' ELSE kind END AS kind, CASE WHEN kind = 'assign' AND value < 12 THEN 4 ELSE rank END AS rank,
    CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM y
  WHERE CASE kind WHEN 'assign' THEN value >= 6 WHEN 'access' THEN length(hit) >= 18 WHEN 'hex' THEN length(hit) >= 16
    WHEN 'weak_access' THEN length(hit) < 18 OR NOT starts_with(hit, 'AKIA') ELSE true END),
r AS (SELECT *, CASE WHEN kind IN ('assign', 'hex', 'weak_secret') THEN 'secret' WHEN kind IN ('access', 'weak_access') THEN 'access' ELSE 'endpoint' END AS role FROM s),
k AS (SELECT *, kind IN ('assign', 'access', 'hex') AS base FROM r WHERE kind IN ('assign', 'access', 'hex') OR EXISTS (SELECT 1 FROM r q WHERE q.row = r.row AND q.start <= r.stop + 400 AND q.stop >= r.start - 400
  AND CASE r.kind WHEN 'weak_secret' THEN q.role IN ('access', 'endpoint') ELSE q.role = 'secret' END)),
g AS (SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE base) AS based, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS joined FROM k GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(based, '')) AS base_sha256, coalesce(joined, '') AS spans
FROM e LEFT JOIN g USING (row)
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.replace('text', "coalesce(text, '')")} AS w FROM documents),
h AS (SELECT row, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(list_slice(w, i, i + 34), ' ')))) AS h,
  unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
r AS (SELECT row, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE len(w) > 0),
k AS (SELECT x.row, count(*) FILTER (WHERE c.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL), '') AS kept
  FROM x LEFT JOIN c ON x.row = c.row AND x.p = c.p GROUP BY x.row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row)
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS g FROM d),
e AS (SELECT row, unnest(g) AS x FROM s),
c AS (SELECT a.row AS a, b.row AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.row <> b.row GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s p ON p.row = a JOIN s q ON q.row = b WHERE 100 * n >= 85 * (len(p.g) + len(q.g) - n)),
r AS (SELECT row, row AS seen FROM d UNION SELECT r.row, l.b FROM r JOIN l ON r.seen = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN r ON r.row = s.row JOIN d t ON t.row = r.seen GROUP BY s.row, s.doc_id, len(s.g)
"""

OP1 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.row AS a, b.row AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.row <> b.row
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT row, row AS seen FROM v UNION SELECT r.row, l.b FROM r JOIN l ON r.seen = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(t.vec_id) AS component_id, coalesce(v.vec_id = min(t.vec_id), true) AS kept
FROM v JOIN r ON r.row = v.row JOIN v t ON t.row = r.seen LEFT JOIN n ON n.a = v.row GROUP BY v.row, v.vec_id
"""

_ESCAPE = r"replace(replace(replace(replace({0}, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>')"
_SAID = r"'\### Assistant: </turn> ok'"

OP8 = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(length('<turn><says></turn>') + 1 + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')})) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""

ORACLES = {"op8_chat_format": OP8, "op1_embedding_dedup": OP1, "op6_jaccard_join": OP6, "op10_substring_dedup": OP10, "op3_warc_archive": OP3, "op4_url_filter": OP4, "op7_secret_links": OP7, "op9_mix": OP9}
