"""Query and SQL of the secret scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.registry import register, table
from tableprobe.llm.secrets import BASE, find

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT r, doc_id, source, 0 AS rank, 'assign' AS kind, 12 AS least, string_split_regex(t, '{ASSIGN}') AS gaps,
         regexp_extract_all(t, '{ASSIGN}') AS whole, regexp_extract_all(t, '{ASSIGN}', 2) AS value FROM d
  UNION ALL
  SELECT r, doc_id, source, 1, 'access', 18, string_split_regex(t, 'AKIA[A-Z0-9]+'),
         regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT r, doc_id, source, 2, 'hex', 16, string_split_regex(t, '[0-9a-f]+'),
         regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL
  SELECT r, doc_id, source, 3, 'copy', 16, string_split_regex(t, '[A-Za-z0-9+/_.=-]+'),
         regexp_extract_all(t, '[A-Za-z0-9+/_.=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_.=-]+') FROM d
), one AS (
  SELECT r, doc_id, source, rank, kind, least, i, gaps[i] AS gap, whole[i] AS whole, value[i] AS value
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM k)
), placed AS (
  SELECT *, "end" - length(whole) AS start, sha256(value) AS h FROM (
    SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS "end" FROM one)
  WHERE length(value) >= least AND (rank < 3 OR regexp_matches(value, '[0-9]'))
), chars AS (
  SELECT h, n / sum(n) OVER (PARTITION BY h) AS share FROM (
    SELECT h, c, count(*) AS n FROM (SELECT h, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT h, value FROM placed WHERE rank < 3)) GROUP BY ALL)
), random AS (
  SELECT h, round(-sum(share * log2(share)), 6) >= 3.0 AS random FROM chars GROUP BY h
), known AS (
  SELECT h, owners, repositories, owners <= 1 AND repositories <= 3 AND random AS live
  FROM (SELECT h, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS repositories FROM placed WHERE rank < 3 GROUP BY h)
  JOIN random USING (h)
), judged AS (
  SELECT p.r, p.rank, p.kind, p.start, p."end", live FROM placed p LEFT JOIN known USING (h)
  WHERE rank < 3 OR (live AND NOT EXISTS (SELECT 1 FROM placed b WHERE b.r = p.r AND b.rank < 3 AND b.start < p."end" AND p.start < b."end"))
), s AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (live) AS n_live
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN s ON s.r = d.r
"""


@register("op4_secret_scans", OP4)
def op4_secret_scans(spark, folder):
    """Every document with its findings; a document stands for a repository, a source for its owner."""
    found = find(table(spark, folder, "documents"))
    spans = F.col("spans_")

    def count(rank: int):
        return F.size(F.filter(spans, lambda f: f["rank"] == rank)).cast("long")

    def joined(rows):
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter(spans, lambda f: f["rank"] < len(BASE))
    return found.select(
        F.col("key_").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda f: F.coalesce(f["live"], F.lit(False)))).cast("long").alias("n_live"),
    )
