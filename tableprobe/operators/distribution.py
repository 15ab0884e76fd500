"""Equal-width histograms of many columns in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.columns import finite, ref
from tableprobe.operators.numeric import moments

BINS = 30
FIELDS = "column string, bin int, n long, bin_start double, bin_end double, bin_center double, bin_width double"


def histograms(df: DataFrame, columns: list[str], bins: int = BINS, moment_rows: list | None = None) -> DataFrame:
    """``bins`` rows per column with edges, centre, width and count; empty bins are kept.

    The range of every column comes from the moments (a few numbers per column); a constant
    gets a range of one around it; a column without finite values has no rows.
    """
    found = {r["column"]: r for r in (moment_rows or moments(df, columns).collect())}
    ranges = bin_ranges([found[c] for c in columns])
    spark = df.sparkSession
    if not ranges:
        return spark.createDataFrame([], FIELDS)
    binned = []
    for c, (low, high) in ranges.items():
        share = (finite(ref(c)) - F.lit(low)) / F.lit(high - low)
        last = F.lit(bins - 1)
        cell = F.floor(share * bins)
        binned.append(F.when(cell > last, last).otherwise(cell).cast("int").alias(c))
    counted = (
        df.select(*binned)
        .unpivot([], [ref(c) for c in ranges], "column", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = spark.createDataFrame(
        [(c, low, high) for c, (low, high) in ranges.items()], "column string, low double, high double"
    ).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    start = F.col("low") + F.col("bin") * width
    return grid.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        start.alias("bin_start"),
        (start + width).alias("bin_end"),
        (start + width / 2).alias("bin_center"),
        width.alias("bin_width"),
    )


def bin_ranges(moment_rows: list) -> dict[str, tuple[float, float]]:
    """The range of every column that has a finite value; a constant gets one around it."""
    out = {}
    for r in moment_rows:
        low, high = r["min"], r["max"]
        if low is not None:
            out[r["column"]] = (low - 0.5, high + 0.5) if low == high else (low, high)
    return out


def histogram_rows(spark: SparkSession, ranges: dict[str, tuple[float, float]], counts: dict[str, list[int]]) -> DataFrame:
    """The rows of :func:`histograms` from counts per bin, a few per column."""
    rows = []
    for c, (low, high) in ranges.items():
        width = (high - low) / len(counts[c])
        for k, n in enumerate(counts[c]):
            start = low + k * width
            rows.append((c, k, n, start, start + width, start + width / 2, width))
    return spark.createDataFrame(rows, FIELDS)
