"""DuckDB SQL for those registered queries that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

OP2 = rf"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_LOWER}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(h, q, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(struct_pack(rule := h || q, verdict := verdict), length(h || q)) FROM r
     WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS best
  FROM p)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(spam-farm|casino|porn|xxx|viagra)([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM p),
o AS (SELECT d, max(page_id) AS owner FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, q.d AS payload_digest,
  CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM q LEFT JOIN o ON q.d = o.d
"""

OP6 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dg.n FROM dg JOIN win ON dg.n = win.n AND dg.t = win.t),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2, "op4_warc": OP4, "op6_decontaminate": OP6, "op10_line_dedup": OP10}
