"""Query of the n-gram Jaccard join; tests compare it with all pairs by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.registry import register, table
from tableprobe.llm.signature_trees import jaccard_components


@register("op13_ngram_jaccard_join")
def op13_ngram_jaccard_join(spark, folder):
    """Every document with its component of links at 90 % of three-word shingles."""
    found = jaccard_components(table(spark, folder, "documents"), size=3, percent=90)
    return found.select(F.col("key_").alias("doc_id"), F.col("n_shingles_").alias("n_shingles"), F.col("component_").alias("component_id"))
