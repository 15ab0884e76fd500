"""Query of the packed token ids; tests compare it with the tokenizer on whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tableprobe.llm.packed_ids import read_documents, write
from tableprobe.llm.registry import register, table
from tableprobe.session import checkpoint_folder

END_ID = 2


def vocabulary_path() -> str:
    """Where the public vocabulary lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stored_ids(spark, docs, path: str | None = None):
    """Write the documents below the shared folder and read them back: one row per document."""
    folder = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, folder, path or vocabulary_path(), END_ID)
    return read_documents(spark, folder).select(F.col("key_").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@register("op5_packed_ids")
def op5_packed_ids(spark, folder):
    """Every document's place, length and checksum as read back from the files."""
    return stored_ids(spark, table(spark, folder, "documents"))
