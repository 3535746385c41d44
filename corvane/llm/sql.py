"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others learn models, hash with XXH64, or follow links to their end; tests hold them against plain versions.
"""

from __future__ import annotations

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weights AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0 * source_size AS most FROM sources),
ranked AS (
  SELECT *, most / w AS ratio,
         (1.5 * sum(source_size) OVER () - (sum(most) OVER filled - most)) / (sum(w) OVER () - (sum(w) OVER filled - w)) AS level
  FROM weights WINDOW filled AS (ORDER BY most / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
chosen AS (SELECT arg_min(level, ratio) AS level FROM ranked WHERE level <= ratio * (1 + 1e-12)),
targets AS (SELECT source, source_size, round(least(w * coalesce(chosen.level, 'inf'::DOUBLE), most), 6) AS target FROM ranked, chosen),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed"""


CODE_PARTS = """
ints AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p AS pos, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS part FROM ints, range(8) AS t(p)),
first AS (SELECT vec_id, min(v) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS k FROM ints GROUP BY vec_id ORDER BY vec_id NULLS LAST LIMIT 16),
book0 AS MATERIALIZED (SELECT p AS pos, k, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS part FROM first, range(8) AS t(p))"""

#: A round: the nearest entry of every part, then the floored means.
CODE_NEAREST = """
near{0} AS MATERIALIZED (
  SELECT r, p.pos, any_value(p.part) AS part, min({{'d': CAST(list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': k}}) AS best
  FROM parts p JOIN book{0} b USING (pos) GROUP BY r, p.pos)"""
CODE_MEANS = """
sums{0} AS (SELECT pos, best.k AS k, j, CAST(sum(part[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS j FROM near{0}) GROUP BY ALL),
book{1} AS MATERIALIZED (
  SELECT b.pos, b.k, coalesce(m.part, b.part) AS part FROM book{0} b
  LEFT JOIN (SELECT pos, k, list((s - (s % n + n) % n) // n ORDER BY j) AS part FROM sums{0} GROUP BY pos, k) m USING (pos, k))"""

CODES = "WITH " + ",".join([CODE_PARTS, *[CODE_NEAREST.format(k) + "," + CODE_MEANS.format(k, k + 1) for k in range(6)], CODE_NEAREST.format(6)]) + """,
coded AS (
  SELECT r, string_agg(lower(printf('%02x', best.k)), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near6 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, k)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM ints JOIN coded USING (r), digest"""


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": MIXING, "op12_codes": CODES}
