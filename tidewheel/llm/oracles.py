"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_BY_SPACE = r"[^\x20\x09-\x0D]+"
_BY_SIGN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
k AS (SELECT s, max(page_id) AS keeper FROM p GROUP BY s)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(p.s, CAST(1 + (5 * i) // 4 AS INT), 2))::INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to, url
FROM p JOIN k ON p.s = k.s
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BY_SPACE}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BY_SIGN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_BY_SIGN}') AS w FROM benchmark),
z AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS g
      FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM z)),
x AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
o AS (SELECT x.doc_id, x.i, x.k, q.item_id FROM x JOIN q ON q.k = x.k AND q.g = array_to_string(list_slice(x.w, x.i + 1, x.i + x.k), ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM o GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BY_SPACE}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
x AS (SELECT doc_id, source, unnest(l) AS line FROM d),
y AS (
  SELECT doc_id, source, len(regexp_extract_all(line, '{_BY_SPACE}')) AS n,
    ('0x' || substr(md5(regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')), 1, 15))::BIGINT AS h FROM x
),
-- Documents of a host with the same set of lines count once.
c AS (SELECT doc_id, source, string_agg(DISTINCT h::VARCHAR, ',' ORDER BY h::VARCHAR) AS lines FROM y GROUP BY doc_id, source),
t AS (SELECT y.source, y.h FROM y JOIN c ON c.doc_id = y.doc_id AND c.source IS NOT DISTINCT FROM y.source GROUP BY ALL HAVING count(DISTINCT c.lines) > 20),
e AS (SELECT doc_id, sum(n) AS n FROM y JOIN t ON t.source IS NOT DISTINCT FROM y.source AND t.h = y.h GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(e.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - removed_words) * 100 < n_words * 20) AS kept FROM m
"""

ORACLE = {"op2_warc": WARC, "op3_ngram_join": NGRAM_JOIN, "op6_decontamination": DECONTAMINATION, "op10_quality": QUALITY}
