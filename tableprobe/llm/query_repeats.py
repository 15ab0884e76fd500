"""Query of the substring dedup; tests compare it with all windows by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.registry import register, table
from tableprobe.llm.repeats import remove_repeats


@register("op7_substring_dedup")
def op7_substring_dedup(spark, folder):
    """Every document with the words that stay once repeated windows of 13 words have gone."""
    return remove_repeats(table(spark, folder, "documents")).select(
        F.col("key_").alias("doc_id"),
        F.col("n_words_").alias("n_words"),
        F.col("n_removed_").alias("n_removed"),
        F.sha2("kept_", 256).alias("kept_sha256"),
    )
