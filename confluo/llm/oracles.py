"""DuckDB SQL of the operators that SQL can express by brute force."""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN len([x FOR x IN embedding IF isfinite(x)]) = len(embedding) THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings
), g AS (
  SELECT * FROM (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v) WHERE label IS NOT NULL AND norm > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), r(u, w) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
), n AS (
  SELECT u, count(*) AS n FROM l GROUP BY u
)
SELECT r.u AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.w) AS component_id, r.u = min(r.w) AS kept
FROM r LEFT JOIN n ON n.u = r.u GROUP BY r.u
"""

SUFFIX_DEDUP = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
), p AS (
  SELECT doc_id, h, unnest(generate_series(0, n_bytes - 400, 200)) AS base, n_bytes FROM d WHERE n_bytes >= 400
), q AS (
  SELECT doc_id, base, substr(h, 2 * base + 1, 1198) AS part, least(199, n_bytes - 400 - base) AS last FROM p
), k AS (
  SELECT doc_id, base + o AS s, md5(substr(part, 2 * o + 1, 800)) AS k FROM (SELECT doc_id, base, part, unnest(generate_series(0, last)) AS o FROM q)
), m AS (
  SELECT k FROM k GROUP BY k HAVING count(*) > 1
), f AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400, true) AS opens FROM k JOIN m USING (k)
), i AS (
  SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM f
), b AS (
  SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM i GROUP BY doc_id, run
), t AS (
  SELECT b.doc_id, h, a, z, coalesce(lag(z) OVER w, 0) AS before, lead(a) OVER w IS NULL AS ends FROM b JOIN d USING (doc_id) WINDOW w AS (PARTITION BY b.doc_id ORDER BY a)
), c AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN ends THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM t GROUP BY doc_id
), w AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) > 50
), wk AS (
  SELECT doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)) AS k FROM w
), wm AS (
  SELECT k FROM wk WHERE i <= n - 50 GROUP BY k HAVING count(*) > 1
), wl AS (
  SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 51) AS ahead FROM wk JOIN wm USING (k) WHERE i <= n - 50
), wc AS (
  SELECT doc_id, sum(least(51, ahead)) AS repeated_words FROM wl GROUP BY doc_id
)
SELECT d.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256,
  CAST(coalesce(repeated_words, 0) AS BIGINT) AS repeated_words
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN wc USING (doc_id)
"""
