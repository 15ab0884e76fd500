"""Registered queries: name → Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import ref

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}

DIGITS = 6


class Tables:
    """The given tables as attributes: ``t.lineitem`` reads ``lineitem.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, covers: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``; doubles are rounded on the way out."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(Tables(spark, sf_dir)))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(
        *[
            F.round(ref(f.name).cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else ref(f.name)
            for f in df.schema.fields
        ]
    )


def r(expression: str) -> str:
    """SQL for a rounded double without negative zero."""
    return f"(round(({expression})::DOUBLE, {DIGITS}) + 0.0)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def scratch(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder, which all executors share."""
    from tableprobe.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
