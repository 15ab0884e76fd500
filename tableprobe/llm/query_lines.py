"""Query of the line dedup; tests compare it with all pairs of lines by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.line_dedup import repeated_lines
from tableprobe.llm.registry import register, table


@register("op9_line_dedup")
def op9_line_dedup(spark, folder):
    """Every document with the lines that go because they, or nearly they, occur earlier."""
    return repeated_lines(table(spark, folder, "documents")).select(
        F.col("key_").alias("doc_id"),
        F.col("lines_").alias("n_lines"),
        F.size("removed_").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_").cast("array<string>"), ",").alias("removed_lines"),
    )
