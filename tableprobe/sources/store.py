"""Previews, JSON records and the result store."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.columns import json_safe

PREVIEW_ROWS = 100
RUNS = "runs"  # which run of a dataset counts


def preview(df: DataFrame, order: list[Column], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in the given order, safe for JSON."""
    return json_safe(df.orderBy(*order).limit(rows))


def shape(df: DataFrame) -> DataFrame:
    """One row: n_rows and n_cols."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"))


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, column string, type string"
    )


def check_target(df: DataFrame, target: str | None) -> None:
    """Refuse an unknown target before any job starts."""
    if target is not None and target not in df.columns:
        raise ValueError(f"no column {target!r}; there are: {', '.join(df.columns)}")


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, one object per line, NaN and infinities as null."""
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Records written line by line or as one JSON list per file; a folder may hold both kinds.

    Each file is judged by its first character that is not blank, and each kind is one read.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    lists = _list_files(spark, path)
    if not any(lists.values()) or all(lists.values()):
        return reader.option("multiLine", any(lists.values())).json(path)
    parts = [
        reader.option("multiLine", multi).json([name for name, is_list in lists.items() if is_list == multi])
        for multi in (False, True)
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def _list_files(spark: SparkSession, path: str) -> dict[str, bool]:
    """Per file whether it holds one JSON list. The driver gets one row per file."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    first = lines.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.ltrim("value").substr(1, 1).alias("sign"))
    found = first.groupBy("path").agg(F.min_by("sign", "place").alias("sign"))
    return {r["path"]: r["sign"] == "[" for r in found.collect()}


def records_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """Stored records, or None when nothing is stored yet."""
    try:
        return read_records(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def save_results(results: dict[str, DataFrame], path: str) -> None:
    """Write the parts of a run; all parts of the same dataset from an older run are replaced.

    Each part is a Parquet table partitioned by dataset and run. Which run of a dataset counts is
    written last, so a part that is empty now replaces an older one that was not, and a run that
    breaks off leaves the older one in force.
    """
    run = uuid.uuid4().hex
    datasets = [part.select("dataset").distinct() for part in results.values()]
    for name, part in results.items():
        part.withColumn("run", F.lit(run)).write.mode("append").partitionBy("dataset", "run").parquet(f"{path}/{name}")
    current = reduce(DataFrame.unionByName, datasets).distinct().withColumn("run", F.lit(run))
    current.withColumn("saved", F.current_timestamp()).write.mode("append").parquet(f"{path}/{RUNS}")


def load_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A part of the latest run of every dataset."""
    runs = spark.read.parquet(f"{path}/{RUNS}")
    latest = runs.groupBy("dataset").agg(F.max_by("run", "saved").alias("run"))
    return spark.read.parquet(f"{path}/{name}").join(latest, ["dataset", "run"], "left_semi").drop("run")
