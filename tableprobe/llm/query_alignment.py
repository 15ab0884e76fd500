"""Query of the cross-tokenizer alignment; tests compare it with whole texts by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprobe.llm.alignment import Alignment
from tableprobe.llm.registry import register, table


@register("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark, folder):
    """Every document's tokens, groups and links between two public vocabularies."""
    import public_tokenizers

    path = public_tokenizers.path
    found = Alignment(table(spark, folder, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")).documents()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select(F.col("key_").alias("doc_id"), *names, F.col("groups_").alias("groups_sha256"))
