"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tableprobe.session import checkpoint_folder

ROW_GROUP_BYTES = 16 << 20  # what a writing task holds


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below the shared folder and read back: no lineage, columns read as needed."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
