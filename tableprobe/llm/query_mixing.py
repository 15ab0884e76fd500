"""Query and SQL of the mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.mixing import mix, plan, word_count
from tableprobe.llm.registry import register, table

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n
  FROM documents
), s AS (
  SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY source
), t AS (
  SELECT CAST(sum(tokens) AS DOUBLE) AS total, count(*) AS sources FROM s WHERE tokens > 0
), entropy(low, high) AS (  -- the last exponent that reaches 0.95 of the greatest entropy
  SELECT CASE WHEN (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) FROM (SELECT tokens / total AS p FROM s, t WHERE tokens > 0)) < 0.95 * ln(sources)
              THEN 0 ELSE 1000000 END, CASE WHEN sources > 0 THEN 1000000 END + 0 FROM t
  UNION ALL
  SELECT CASE WHEN below THEN low ELSE mid END, CASE WHEN below THEN mid ELSE high END
  FROM (
    SELECT low, high, mid, (
        SELECT ln(sum(w)) - sum(w * ln(w)) / sum(w) FROM (SELECT pow(tokens / total, mid / 1000000) AS w FROM s, t WHERE tokens > 0)
      ) < 0.95 * (SELECT ln(sources) FROM t) AS below
    FROM (SELECT low, high, (low + high) // 2 AS mid FROM entropy WHERE high - low > 1))
), repeats(low, high) AS (  -- the first exponent with at most four repetitions
  SELECT CASE WHEN (SELECT max(total / tokens) / count(*) FROM s, t WHERE tokens > 0) <= 4.0 THEN -1 ELSE 0 END,
         CASE WHEN (SELECT max(total / tokens) / count(*) FROM s, t WHERE tokens > 0) <= 4.0 THEN 0 ELSE 1000000 END
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
  FROM (
    SELECT low, high, mid, (
        SELECT max(pow(tokens / total, mid / 1000000 - 1.0)) / sum(pow(tokens / total, mid / 1000000)) FROM s, t WHERE tokens > 0
      ) <= 4.0 AS fits
    FROM (SELECT low, high, (low + high) // 2 AS mid FROM repeats WHERE high - low > 1))
), a AS (
  SELECT greatest((SELECT max(low) FROM entropy), (SELECT min(high) FROM repeats)) / 1000000 AS a
), w AS (
  SELECT s.*, pow(tokens / total, a) / sum(CASE WHEN tokens > 0 THEN pow(tokens / total, a) END) OVER () AS weight, total FROM s, t, a
), g AS (
  SELECT *, CAST(floor(round(weight * total, 3)) AS BIGINT) AS goal, CAST(ceil(docs / 4096) AS BIGINT) AS blocks FROM w WHERE tokens > 0
), h AS (
  SELECT *, goal // tokens AS epochs, goal - (goal // tokens) * tokens AS rest FROM g
), p AS (
  SELECT d.*, weight, epochs, rest, CAST('0x' || substr(md5('block:' || name), 1, 8) AS BIGINT) % blocks AS block FROM d JOIN h USING (source)
), o AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY md5('7:' || (epochs + 1) || ':' || source || '/' || block), md5('7:' || (epochs + 1) || ':' || name)) AS so_far FROM p
), c AS (
  SELECT *, epochs + CASE WHEN so_far <= rest AND rest > 0 THEN 1 ELSE 0 END AS copies FROM o
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block, n AS n_tokens, round(weight, 9) AS weight,
       md5('7:' || epoch || ':' || source || '/' || block) || md5('7:' || epoch || ':' || name) AS place
FROM (SELECT *, unnest(range(1, copies + 1)) AS epoch FROM c)
"""


@register("op3_source_mixing", OP3)
def op3_source_mixing(spark, folder):
    """Every document as often as the mix takes it; the budget is the size of the corpus."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    sources, count = plan(docs)
    mixed = mix(docs, sources, count).withColumn("n_tokens", word_count(F.col("text")))
    weights = F.broadcast(sources.select("source_", F.round("weight_", 9).alias("weight"))) if count <= 50_000 else sources.select("source_", F.round("weight_", 9).alias("weight"))
    return mixed.join(weights, "source_").select(
        "doc_id",
        F.col("source_").alias("source"),
        F.col("epoch_").alias("epoch"),
        F.col("block_").alias("block"),
        "n_tokens",
        "weight",
        F.col("place_").alias("place"),
    )
