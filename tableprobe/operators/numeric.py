"""Statistics of numeric columns: moments, outliers and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.operators import states
from tableprobe.operators.order_stats import long_values, quantiles

# Fence factor, z limit and coefficient of variation.
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
MIN_CV = 0.01

MOMENT_FIELDS = "column string, n_finite long, mean double, std double, skewness double, kurtosis double, min double, max double"


def population_skewness(value: Column) -> Column:
    """NULL below three values and for a constant."""
    return F.when(F.count(value) >= 3, F.skewness(value))


def population_kurtosis(value: Column) -> Column:
    """Excess kurtosis; NULL below four values and for a constant."""
    return F.when(F.count(value) >= 4, F.kurtosis(value))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n_finite, mean, std (population), skewness, kurtosis, min, max.

    All columns in one scan: tasks hold the central moments of their rows and merge them, whatever the
    width of the table.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], MOMENT_FIELDS)
    found = states.moments_of(states.scan(df, columns, [states.Moments()]), columns)
    return moment_table(df.sparkSession, list(found.values()))


def moment_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Moments, one dictionary per column, as a table."""
    return spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in MOMENT_FIELDS.split(", ")) for r in rows], MOMENT_FIELDS)


def every_column(spark: SparkSession, columns: list[str]) -> DataFrame:
    """The column names as a table, so that columns without values keep their row."""
    return F.broadcast(spark.createDataFrame([(c,) for c in columns], "column string"))


def fence(lower: float | None, upper: float | None) -> tuple[float, float] | None:
    """Outlier fences from two quartiles."""
    if lower is None:
        return None
    reach = IQR_FACTOR * (upper - lower)
    return lower - reach, upper + reach


def fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    """Outlier fences from the exact quartiles."""
    return {c: fence(q[0.25], q[0.75]) for c, q in quantiles(df, columns, [0.25, 0.75]).items()}


def outliers(
    df: DataFrame,
    columns: list[str],
    normal: set[str] | frozenset[str] = frozenset(),
    moment_rows: list | None = None,
    fence_of: dict | None = None,
) -> DataFrame:
    """One row per column: counts by both methods, and the chosen count and share.

    ``normal`` names the columns judged normal; they use the z-score, the others the
    fences. ``moment_rows`` and ``fence_of`` are reused when already known.
    """
    if not columns:
        return df.sparkSession.createDataFrame(
            [],
            "column string, n_finite long, iqr_outliers long, z_outliers long, n_outliers long, outliers_pct double",
        )
    spark = df.sparkSession
    by_column = {r["column"]: r for r in (moment_rows or moments(df, columns).collect())}
    if fence_of is None:
        fence_of = fences(df, columns)
    limits = []
    for c in columns:
        low, high = fence_of[c] or (None, None)
        limits.append((c, low, high, by_column[c]["mean"], by_column[c]["std"], c in normal))
    bounds = F.broadcast(  # one row per column
        spark.createDataFrame(limits, "column string, low double, high double, mean double, std double, normal boolean")
    )
    value = F.col("value")
    z = F.try_divide(F.abs(value - F.col("mean")), F.col("std"))
    counted = long_values(df, columns).join(bounds, "column").groupBy("column").agg(
        F.count(F.lit(1)).alias("n_finite"),
        F.count(F.when((value < F.col("low")) | (value > F.col("high")), 1)).alias("iqr_outliers"),
        F.count(F.when(z > Z_LIMIT, 1)).alias("z_outliers"),
    )
    joined = bounds.join(counted, "column", "left").na.fill(0, ["n_finite", "iqr_outliers", "z_outliers"])
    chosen = F.when(F.col("normal"), F.col("z_outliers")).otherwise(F.col("iqr_outliers"))
    return joined.select(
        "column",
        "n_finite",
        "iqr_outliers",
        "z_outliers",
        chosen.alias("n_outliers"),
        F.coalesce(F.try_divide(chosen, F.col("n_finite")), F.lit(0.0)).alias("outliers_pct"),
    )


def low_variance(mean: Column, std: Column, min_cv: Column | float = MIN_CV) -> Column:
    """A constant, or a spread that is tiny beside the mean."""
    return (std == 0) | ((mean != 0) & (std / F.abs(F.nullif(mean, F.lit(0.0))) < min_cv))


def numeric_summary(per_column: DataFrame) -> DataFrame:
    """One row over columns that carry moments, ``n_outliers`` and ``p_value``."""
    return per_column.agg(
        F.avg("skewness").alias("mean_skewness"),
        F.avg("kurtosis").alias("mean_kurtosis"),
        F.median("p_value").alias("normality_test_pvalue"),
        F.coalesce(F.try_divide(F.sum("n_outliers"), F.sum("n_finite")), F.lit(0.0)).alias("outliers_pct"),
        F.count(F.when(low_variance(F.col("mean"), F.col("std")), 1)).alias("n_low_variance"),
    )
