"""Query of the language identification; tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.language import fit, held_out, identify
from tableprobe.llm.registry import register, table


@register("op8_language_id")
def op8_language_id(spark, folder):
    """Every document with its predicted language."""
    docs = table(spark, folder, "documents")
    return identify(docs, fit(docs)).select(
        F.col("key_").alias("doc_id"),
        held_out(F.col("key_")).alias("held_out"),
        F.col("lang_").alias("lang_pred"),
        F.col("score_").alias("score"),
    )
