"""Profile vectors and distances between arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableprobe.functions.columns import ref, safe_double
from tableprobe.functions.scalars import features_to_rows

# The order of the profile features in a vector and the padded length.
FEATURE_ORDER = [
    "n_rows",
    "n_cols",
    "memory_mb",
    "__features_to_rows_ratio__",
    "total_missing_pct",
    "max_col_missing_pct",
    "duplicate_rows_pct",
    "mean_skewness",
    "mean_kurtosis",
    "normality_test_pvalue",
    "outliers_pct",
    "target_n_unique",
    "max_abs_correlation",
    "target_correlation_max",
    "target_mutual_information_max",
    "target_mutual_information_mean",
]
VECTOR_LENGTH = 128
RATIO_FEATURE = "__features_to_rows_ratio__"

METRICS = ("cosine", "euclidean", "manhattan")


def feature_values() -> list[Column]:
    """One finite double per feature, taken from the columns of a profile row."""
    return [
        features_to_rows(safe_double(ref("n_cols")), safe_double(ref("n_rows")))
        if name == RATIO_FEATURE
        else safe_double(ref(name))
        for name in FEATURE_ORDER
    ]


def feature_vector() -> Column:
    return F.array(*feature_values())


def pad(vector: Column, length: int = VECTOR_LENGTH) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(vector)))


def order_fingerprint() -> Column:
    """SHA-256 of the feature order; stored beside a vector and compared on reading."""
    return F.sha2(F.lit(",".join(FEATURE_ORDER)), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Cosine, euclidean or manhattan distance of two ``array<double>`` columns."""
    check_metric(metric)
    if metric == "cosine":
        return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "euclidean":
        gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v))
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {', '.join(METRICS)}")
