"""The table of quality rules: thresholds and severities are data, not code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableprobe.operators.service import insert_absent

# Rule codes, severities and default thresholds.
RULES = [
    ("TARGET_MISSING", "Missing values in the target", "critical", {"max_target_missing_pct": 0.05}),
    ("LEAKAGE_SUSPICION", "Suspected target leakage", "critical",
     {"max_correlation_with_target": 0.95, "max_mutual_info_with_target": 0.9}),
    ("HIGH_MISSING", "Many missing values in a column", "warning", {"max_col_missing_pct": 0.3}),
    ("DUPLICATES", "Duplicate rows", "warning", {"max_duplicates_pct": 0.05}),
    ("IMBALANCE_BINARY", "Unbalanced binary target", "warning", {"max_imbalance_ratio": 10.0}),
    ("IMBALANCE_MULTICLASS", "Too few rows in a class", "warning", {"min_class_size": 50.0}),
    ("SMALL_DATASET", "Small table", "warning", {"min_rows": 100.0}),
    ("TOO_FEW_FEATURES", "Too few features", "warning", {"min_cols": 3.0}),
    ("LOW_VARIANCE", "Feature with little variation", "info", {"min_cv": 0.01, "min_normalized_entropy": 0.1}),
    ("HIGH_CARDINALITY", "Many distinct categories", "info", {"max_cardinality_ratio": 0.5}),
    ("OUTLIERS", "Outliers in a numeric feature", "info", {"max_outliers_pct": 0.05}),
    ("DATE_NOT_PARSED", "Date stored as text", "info", {"min_date_parse_rate": 0.9}),
]

RULE_FIELDS = "rule_code string, rule_name string, severity string, thresholds map<string,double>, is_active boolean"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, True) for r in RULES], RULE_FIELDS)


def seed_rules(stored: DataFrame) -> DataFrame:
    """Add the default rules that are not stored yet; stored ones keep their thresholds."""
    return insert_absent(stored, default_rules(stored.sparkSession), "rule_code")
