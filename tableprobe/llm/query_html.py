"""Query of the HTML extraction; rendering has no SQL, tests compare small pages with their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.html_text import extract
from tableprobe.llm.registry import register, table


@register("op10_html_extraction")
def op10_html_extraction(spark, folder):
    """Every page with its visible text."""
    found = extract(table(spark, folder, "pages"))
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return found.select(
        F.col("key_").alias("page_id"),
        "text",
        F.length("text").cast("long").alias("n_chars"),
        lines.cast("long").alias("n_lines"),
    )
