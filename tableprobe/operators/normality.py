"""Normality of a column from its moments: the Jarque–Bera test over all rows.

JB = n / 6 · (skewness² + kurtosis² / 4), with p = exp(−JB / 2). The moments of a profile are all
it needs, so it costs no scan of its own and does not depend on the layout of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.operators.numeric import moments

# Fixed value: significance level of the test.
ALPHA = 0.05


def jarque_bera(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """The statistic; ``kurtosis`` is the excess. NULL without both moments."""
    return n / 6 * (skewness * skewness + kurtosis * kurtosis / 4)


def of_moments(rows: DataFrame) -> DataFrame:
    """``(column, jb, p_value, is_normal)`` of rows of :func:`moments`.

    Fewer than four values or a constant: no p-value and not normal.
    """
    jb = jarque_bera(F.col("n_finite"), F.col("skewness"), F.col("kurtosis"))
    tested = rows.withColumn("jb", F.when(F.col("min") < F.col("max"), jb))
    p = F.exp(-F.col("jb") / 2)
    return tested.select("column", "jb", p.alias("p_value"), F.coalesce(p > ALPHA, F.lit(False)).alias("is_normal"))


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`of_moments` of the numeric columns of ``df``, in one scan."""
    return of_moments(moments(df, columns))
