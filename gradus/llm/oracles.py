"""DuckDB SQL for those queries that SQL can express."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS full_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM s
), o AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT)
           - CAST(coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
         CAST(sum(weight) OVER (ORDER BY full_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS sharing
  FROM w
), f AS (
  SELECT *, full_size * sharing <= remaining * weight AS is_full FROM o
), l AS (
  SELECT *, max(CASE WHEN NOT is_full THEN remaining / sharing END) OVER () AS level FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(full_size AS DOUBLE) ELSE level * weight END AS target FROM l
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(floor(CAST(round(t.target) AS BIGINT) / greatest(t.source_size, 1)) AS BIGINT) ELSE 0 END AS passes,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start_at
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, budget - passes * source_size - start_at)) AS BIGINT) AS taken
FROM p
"""

NGRAM = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
         ELSE array_to_string(words[i:i + 4], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), c AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), links AS (
  SELECT a.r AS u, b.r AS v FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN c ca ON ca.r = a.r JOIN c cb ON cb.r = b.r
  GROUP BY a.r, b.r, ca.n, cb.n HAVING 100 * count(*) >= 80 * (ca.n + cb.n - count(*))
), reach(u, v) AS (
  SELECT r, r FROM w UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
)
SELECT w.doc_id, CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS n_shingles, min(x.doc_id) AS component_id
FROM w LEFT JOIN c ON c.r = w.r JOIN reach ON reach.u = w.r JOIN w x ON x.r = reach.v
GROUP BY w.r, w.doc_id
"""

#: SHA-1 in base 32: five hexadecimal digits make four characters.
WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::INTEGER >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d
"""

ORACLES = {"op7_warc": WARC, "op5_mixing": MIX.replace("{docs}", "documents"), "op10_ngram_join": NGRAM}
