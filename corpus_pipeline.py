"""A corpus on its way to training data, stage by stage.

Each stage takes the documents its predecessor kept and works on all of them; every decision
takes effect in what it returns. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.llm.decontamination import clean
from tableprobe.llm.language import fit, keep_identified
from tableprobe.llm.mixing import mix, plan
from tableprobe.llm.near_duplicates import keep_one
from tableprobe.llm.query_ids import stored_ids
from tableprobe.session import checkpoint_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; no score or margin rejects a text, so one in an unknown language stays."""
    return keep_identified(docs, fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of five-word shingles, the one with the smallest id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark to 70 % or more."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the budget is the size of what is there."""
    sources, count = plan(docs)
    return mix(docs, sources, count).select(*[F.col(f"`{c}`") for c in docs.columns])


def store_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids in the shared folder, and what they read back as: one row per document."""
    return stored_ids(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("packed_ids", store_ids),
]

# Kernel scores, tiling and token ids have no SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{number}-{name}")
            out = spark.read.parquet(f"{folder}/{number}-{name}")
        docs = out
    return docs
