"""What a column looks like as a prediction target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import finite, is_number_label, is_numeric, nan_to_null, ref
from tableprobe.operators.categorical import entropy_of, value_counts
from tableprobe.operators.numeric import population_skewness

# A numeric target with at most this many values (or this share) is a class.
MAX_CLASS_VALUES = 20
MAX_CLASS_SHARE = 0.05


def target_kind(numeric: Column, n_distinct: Column, n_values: Column) -> Column:
    """``categorical`` or ``regression``; NULL when there is no value at all."""
    limit = F.greatest(F.lit(MAX_CLASS_VALUES), F.floor(F.lit(MAX_CLASS_SHARE) * n_values))
    return F.when(n_values > 0, F.when(numeric & (n_distinct > limit), "regression").otherwise("categorical"))


def target_stats(df: DataFrame, targets: list[str]) -> DataFrame:
    """One row per candidate target: kind, distinct values, imbalance, entropy, skewness.

    All candidates share one shuffle of value counts and one scan for the skewness.
    """
    numeric = [f.name for f in df.schema.fields if f.name in targets and is_numeric(f.dataType)]
    counts = value_counts(df, targets)
    per = counts.groupBy("column").agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.max("n").alias("largest_class"),
        F.min("n").alias("smallest_class"),
        F.min_by("value", F.struct("n", "value")).alias("smallest_label"),
        F.bool_and(is_number_label(F.col("value"))).alias("all_number_labels"),
        entropy_of(F.col("n")).alias("entropy"),
    )
    skew = skewness_rows(df, targets, numeric)
    joined = F.broadcast(skew).join(per, "column", "left")  # one row per column: bounded by the schema
    kind = target_kind(F.col("is_numeric"), F.col("n_distinct"), F.col("n_values"))
    as_class = F.col("target_kind") == "categorical"
    return joined.withColumn("target_kind", kind).select(
        F.col("column").alias("target"),
        "target_kind",
        F.col("n_distinct").alias("target_n_unique"),
        F.when(as_class & (F.col("n_distinct") >= 2), F.col("largest_class") / F.col("smallest_class")).alias(
            "target_imbalance_ratio"
        ),
        F.when(as_class, F.col("entropy")).alias("target_class_entropy"),
        F.when(~as_class, F.col("skewness")).alias("target_skewness"),
        F.when(as_class, F.col("smallest_class")).alias("min_class_size"),
        F.when(as_class, F.col("smallest_label")).alias("min_class"),
        F.when(as_class, F.col("all_number_labels")).alias("all_number_labels"),
    )


def skewness_rows(df: DataFrame, targets: list[str], numeric: list[str]) -> DataFrame:
    """``(column, is_numeric, skewness)`` for every candidate in one scan."""
    one = df.agg(*[population_skewness(finite(ref(c))).alias(f"s{i}") for i, c in enumerate(numeric)] or [F.count(F.lit(1))])
    rows = [
        F.struct(
            F.lit(t).alias("column"),
            F.lit(t in numeric).alias("is_numeric"),
            (F.col(f"s{numeric.index(t)}") if t in numeric else F.lit(None).cast("double")).alias("skewness"),
        )
        for t in targets
    ]
    return one.select(F.inline(F.array(*rows)))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``(label, n)``, missing targets left out."""
    return value_counts(df.select(ref(target)), [target]).select(F.col("value").alias("label"), "n")


MAX_MAP_CLASSES = 10_000


def class_map(classes: DataFrame) -> DataFrame:
    """One row with ``map<label, n>``, labels in order; refused for more than 10 000 classes."""
    if classes.limit(MAX_MAP_CLASSES + 1).count() > MAX_MAP_CLASSES:
        raise ValueError(f"more than {MAX_MAP_CLASSES} classes; read the counts as rows")
    entries = F.array_sort(F.collect_list(F.struct("label", "n")))
    return classes.agg(F.map_from_entries(entries).alias("value_counts"))


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known."""
    return nan_to_null(df).where(ref(target).isNotNull())
