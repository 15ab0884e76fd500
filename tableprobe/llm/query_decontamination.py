"""Query of the decontamination; tests compare it with tiling of all pairs by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.decontamination import contaminated, overlaps
from tableprobe.llm.registry import register, table


@register("op1_decontamination")
def op1_decontamination(spark, folder):
    """Every document and item of which at least 70 % lies in the document."""
    pairs = overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return contaminated(pairs).select(
        F.col("key_").alias("doc_id"),
        F.col("item_").alias("item_id"),
        "n_tiles",
        F.col("tiled").alias("n_tiled_tokens"),
        F.col("item_tokens").alias("n_item_tokens"),
        "coverage",
    )
