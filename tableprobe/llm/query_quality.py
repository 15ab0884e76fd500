"""Query and SQL of the quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.quality_rules import STOP_WORDS, apply_rules
from tableprobe.llm.registry import register, table

OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS r
  FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter([{", ".join(f"'{s}'" for s in STOP_WORDS)}], lambda s: list_contains(w, s))) AS BIGINT) AS n_stop_words,
         len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
  FROM d LEFT JOIN covered ON covered.r = d.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words <= 100000
         AND word_chars / n_words BETWEEN 3.0 AND 10.0
         AND n_symbols / n_words <= 0.1
         AND n_stop_words >= 2
         AND n_dup_lines / n_lines <= 0.3
         AND bullets / n_lines <= 0.9
         AND ellipses / n_lines <= 0.3 AS kept,
       n_stop_words
FROM m
"""


@register("op2_quality_rules", OP2)
def op2_quality_rules(spark, folder):
    """Every document with its counts, the two base rules and the verdict of the table."""
    judged = apply_rules(table(spark, folder, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        F.col("key_").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & F.col("passed")).alias("kept"),
        "n_stop_words",
    )
