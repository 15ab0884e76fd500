"""Query of the near-duplicate search; tests compare it with all pairs by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.near_duplicates import near_duplicates
from tableprobe.llm.registry import register, table


@register("op6_near_duplicates")
def op6_near_duplicates(spark, folder):
    """Every document with its component of links at 80 % of two-word shingles."""
    found = near_duplicates(table(spark, folder, "documents"), size=2, percent=80)
    return found.select(
        F.col("key_").alias("doc_id"),
        F.col("n_shingles_").alias("n_shingles"),
        F.col("component_").alias("component_id"),
        F.coalesce(F.col("key_") == F.col("component_"), F.lit(True)).alias("kept"),
    )
