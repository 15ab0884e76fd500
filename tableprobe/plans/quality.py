"""Twelve quality rules as one comparison of measured values with the rules table.

Every rule compares a measured value with a threshold. The profile yields the candidates
(rule, column, value), the rules table supplies the thresholds, and one filter keeps what
fires. The rules table is small and fixed (a dozen rows), so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.operators.service import severity_rank

FLAG_FIELDS = ["dataset", "rule_code", "severity", "rule_name", "column", "method", "value", "threshold", "message"]


def _candidate(code: str, value: Column, threshold: str, direction: str, method: str = "", when: Column | None = None) -> Column:
    measured = value.cast("double")
    return F.struct(
        F.lit(code).alias("rule_code"),
        (measured if when is None else F.when(when, measured)).alias("value"),
        F.lit(threshold).alias("threshold_name"),
        F.lit(direction).alias("direction"),
        F.lit(method).alias("method"),
    )


def column_candidates(columns: DataFrame) -> DataFrame:
    """What the column-wise rules measure, from one row per (dataset, column)."""
    feature = ~F.col("is_target")
    mean, std = F.col("mean"), F.col("std")
    variation = F.when(std == 0, F.lit(0.0)).otherwise(std / F.abs(F.nullif(mean, F.lit(0.0))))
    found = F.array(
        _candidate("TARGET_MISSING", F.col("missing_pct"), "max_target_missing_pct", "above", when=F.col("is_target")),
        _candidate("LEAKAGE_SUSPICION", F.abs("target_abs_r"), "max_correlation_with_target", "above", "pearson", feature),
        _candidate("LEAKAGE_SUSPICION", F.col("target_mi"), "max_mutual_info_with_target", "above", "mutual_information", feature),
        _candidate("HIGH_MISSING", F.col("missing_pct"), "max_col_missing_pct", "above", when=feature),
        _candidate("LOW_VARIANCE", variation, "min_cv", "below", "numeric", feature),
        _candidate("LOW_VARIANCE", F.col("normalized_entropy"), "min_normalized_entropy", "below", "categorical", feature),
        _candidate("HIGH_CARDINALITY", F.col("cardinality_ratio"), "max_cardinality_ratio", "above", when=feature),
        _candidate("OUTLIERS", F.col("outliers_pct"), "max_outliers_pct", "above", when=feature),
        _candidate("DATE_NOT_PARSED", F.col("date_share"), "min_date_parse_rate", "at_least"),
    )
    return columns.select("dataset", "column", F.inline(found))


def table_candidates(tables: DataFrame) -> DataFrame:
    """What the table-wise rules measure, from one row per dataset."""
    n_features = F.col("n_cols") - F.when(F.col("target_column").isNull(), 0).otherwise(1)
    classes = F.when(F.col("target_kind") == "categorical", F.col("target_n_unique"))
    found = F.array(
        _candidate("DUPLICATES", F.col("duplicate_rows_pct"), "max_duplicates_pct", "above"),
        _candidate("IMBALANCE_BINARY", F.col("target_imbalance_ratio"), "max_imbalance_ratio", "above", when=classes == 2),
        _candidate("IMBALANCE_MULTICLASS", F.col("min_class_size"), "min_class_size", "below", when=classes >= 3),
        _candidate("SMALL_DATASET", F.col("original_rows"), "min_rows", "below"),
        _candidate("TOO_FEW_FEATURES", n_features, "min_cols", "below"),
    )
    about_target = F.col("rule_code").isin("IMBALANCE_BINARY", "IMBALANCE_MULTICLASS")
    return tables.select("dataset", "target_column", "min_class", "n_rows", F.inline(found)).select(
        "dataset",
        F.when(about_target, F.col("target_column")).alias("column"),
        "rule_code",
        "value",
        "threshold_name",
        "direction",
        "method",
        "min_class",
        "n_rows",
    )


# What each rule measures, by rule and, where a rule has two methods, by method.
MEASURED = {
    "TARGET_MISSING": "share of missing target values",
    "HIGH_MISSING": "share of missing values",
    "DUPLICATES": "share of repeated rows",
    "IMBALANCE_BINARY": "size of the larger class over the smaller",
    "IMBALANCE_MULTICLASS": "rows of the rarest class",
    "SMALL_DATASET": "number of rows",
    "TOO_FEW_FEATURES": "number of features",
    "HIGH_CARDINALITY": "distinct values per row",
    "OUTLIERS": "share of outliers",
    "DATE_NOT_PARSED": "share of texts that read as dates",
    "LEAKAGE_SUSPICION/pearson": "correlation with the target",
    "LEAKAGE_SUSPICION": "information about the target in nats",
    "LOW_VARIANCE/numeric": "spread relative to the mean",
    "LOW_VARIANCE": "normalized entropy",
}
BOUNDS = {"above": "more than", "below": "less than", "at_least": "from"}


def _message() -> Column:
    """``place: measure = value (rule fires bound limit)``, one shape for all rules."""
    code = F.col("rule_code")
    measures = F.create_map(*[F.lit(x) for kv in MEASURED.items() for x in kv])
    bounds = F.create_map(*[F.lit(x) for kv in BOUNDS.items() for x in kv])
    measure = F.coalesce(F.try_element_at(measures, F.concat_ws("/", code, "method")), F.try_element_at(measures, code))
    rarest = F.when(code == "IMBALANCE_MULTICLASS", F.col("min_class"))
    place = F.concat_ws("/", F.coalesce(F.col("column"), F.lit("table")), rarest)
    return F.format_string(
        "%s: %s = %.3f (%s fires %s %.3f)", place, measure, F.col("value").cast("double"), code, bounds[F.col("direction")], F.col("threshold").cast("double")
    )


def quality_flags(tables: DataFrame, columns: DataFrame, rules: DataFrame) -> DataFrame:
    """All flags of all datasets, one row per (dataset, rule, column)."""
    candidates = table_candidates(tables).unionByName(column_candidates(columns), allowMissingColumns=True)
    active = F.broadcast(rules.where("is_active").select("rule_code", "rule_name", "severity", "thresholds"))
    judged = (
        candidates.where(F.col("value").isNotNull())
        .join(active, "rule_code")
        .withColumn("threshold", F.col("thresholds")[F.col("threshold_name")])
    )
    value, limit, way = F.col("value"), F.col("threshold"), F.col("direction")
    constant = (F.col("rule_code") == "LOW_VARIANCE") & (F.col("method") == "numeric") & (value == 0)
    fired = judged.where(
        constant
        | ((way == "above") & (value > limit))
        | ((way == "below") & (value < limit))
        | ((way == "at_least") & (value >= limit))
    )
    flags = fired.withColumn("message", _message()).select(*FLAG_FIELDS)
    return without_repeated_leaks(flags)


def without_repeated_leaks(flags: DataFrame) -> DataFrame:
    """A column flagged by correlation is not flagged again by mutual information."""
    leak = F.col("rule_code") == "LEAKAGE_SUSPICION"
    by_r = flags.where(leak & (F.col("method") == "pearson")).select(
        "dataset", "rule_code", "column", F.lit("mutual_information").alias("method")
    )
    return flags.join(by_r, ["dataset", "rule_code", "column", "method"], "left_anti").select(*flags.columns)


def sorted_flags(flags: DataFrame) -> DataFrame:
    """Worst severity first, then rule and column."""
    return flags.orderBy("dataset", severity_rank(F.col("severity")), "rule_code", "column", "method")


def leakage_columns(flags: DataFrame, dataset: str) -> DataFrame:
    """Columns of one dataset under suspicion of leakage."""
    return flags.where((F.col("dataset") == dataset) & (F.col("rule_code") == "LEAKAGE_SUSPICION")).select("column").distinct()
