"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH s AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, md5(doc_id::VARCHAR) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY src),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 3.0::DOUBLE AS cap
  FROM src),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
lv AS (
  SELECT *, (SELECT min_by(level, (cap / w, src)) FROM l WHERE level * w <= cap) AS first FROM l),
t AS (
  SELECT src, source_size, least(cap, coalesce(first * w, cap)) AS target FROM lv),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS unit,
         CAST('0x' || substr(md5('mix:' || src), 1, 6) AS BIGINT) AS off
  FROM t),
p AS (
  SELECT doc_id, size, source_size, target, unit,
         off + CAST(sum(unit) OVER (PARTITION BY src ORDER BY length(size::VARCHAR), CAST(substr(rpad(size::VARCHAR, 3, '0'), 1, 3) AS INTEGER), h[1:1], size, h, doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM s JOIN u USING (src))
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - unit) >> 24)) * size AS taken FROM p
"""

OP7 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT text_sha256, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN k USING (text_sha256)
"""

OP5 = r"""
WITH t AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""

OP9 = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS found
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(found, 'allow') AS verdict FROM m
"""

ORACLE = {"op1_mixing": OP1, "op5_warc": OP5, "op7_exact_dedup": OP7, "op9_url_filter": OP9}
