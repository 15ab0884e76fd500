"""Statistics of category columns from one table of value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import nan_to_null, ref

TOP_CATEGORIES = 20
LONG_TEXT = 64
LONG_MARK = "\u0001md5:"


def unpivot_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, value)`` with every value as text."""
    texts = df.select(*[ref(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], [ref(c) for c in columns], "column", "value")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, n)`` for all columns in one shuffle; missing values left out.

    Spark counts on the map side first, so a frequent value costs one record per task.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    long = unpivot_text(nan_to_null(df), columns).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def value_key(value: Column) -> Column:
    """The value itself, or a mark and its md5 when it is a long text (or begins with the mark)."""
    return F.when((F.length(value) <= LONG_TEXT) & ~value.startswith(LONG_MARK), value).otherwise(F.concat(F.lit(LONG_MARK), F.md5(value.cast("binary"))))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`value_counts` with long texts replaced by their key.

    Enough for entropy and cardinality, and a column of whole documents shuffles as short
    keys. :func:`with_long_texts` brings the texts back where a few of them are shown.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    long = unpivot_text(nan_to_null(df), columns).where(F.col("value").isNotNull())
    return long.groupBy("column", value_key(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def with_long_texts(rows: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """A few ``(column, value, …)`` rows with keys replaced by the texts they stand for."""
    keys = F.broadcast(  # callers pass a bounded number of rows per column
        rows.where(F.col("value").startswith(LONG_MARK)).select("column", F.col("value").alias("__key"))
    )
    long = unpivot_text(df, columns).where((F.length("value") > LONG_TEXT) | F.col("value").startswith(LONG_MARK))
    found = (
        long.select("column", F.col("value").alias("__text"), value_key(F.col("value")).alias("__key"))
        .join(keys, ["column", "__key"])
        .groupBy("column", "__key")
        .agg(F.first("__text").alias("__text"))
    )
    joined = rows.join(F.broadcast(found), (rows["column"] == found["column"]) & (rows["value"] == found["__key"]), "left")
    return joined.select(
        *[F.coalesce(F.col("__text"), rows["value"]).alias("value") if c == "value" else rows[c] for c in rows.columns]
    )


def entropy_of(n: Column, base_log=F.log2) -> Column:
    """Entropy of counts inside an aggregate, without knowing the total beforehand."""
    total = F.sum(n)
    return F.greatest(F.lit(0.0), base_log(total) - F.sum(n * base_log(n)) / total)


def entropies(counts: DataFrame) -> DataFrame:
    """Per column: n_values, n_distinct, entropy in bits and its share of the maximum."""
    per = counts.groupBy("column").agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_distinct"),
        entropy_of(F.col("n")).alias("entropy"),
    )
    share = F.when(F.col("n_distinct") <= 1, F.lit(0.0)).otherwise(
        F.col("entropy") / F.log2(F.col("n_distinct"))
    )
    return per.withColumn("normalized_entropy", share)


def with_cardinality(per_column: DataFrame, n_rows: int | Column) -> DataFrame:
    """Distinct values over all rows, missing ones included in the rows."""
    rows = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    return per_column.withColumn(
        "cardinality_ratio", F.col("n_distinct") / F.greatest(rows, F.lit(1))
    )


def tie_order(value: Column) -> Column:
    """Order of equally frequent values: by md5, which a value and its key share."""
    key = F.substring(value, len(LONG_MARK) + 1, 32)
    return F.when(value.startswith(LONG_MARK), key).otherwise(F.md5(value.cast("binary")))


def top_values(counts: DataFrame, k: int = TOP_CATEGORIES, group: str = "column") -> DataFrame:
    """The ``k`` most frequent values per column, ties by the md5 of the value.

    The filter on the row number right above the window lets Spark keep only ``k`` rows per
    column and task before the shuffle.
    """
    window = Window.partitionBy(group).orderBy(F.desc("n"), tie_order(F.col("value")))
    return counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_with_rest(counts: DataFrame, k: int = TOP_CATEGORIES, group: str = "column") -> DataFrame:
    """:func:`top_values` and, per column, the count of all other values."""
    top = top_values(counts, k, group)
    # The sum over all values and the sum over the shown ones meet in one small aggregate.
    sums = counts.select(group, F.col("n").alias("rest")).unionByName(top.select(group, (-F.col("n")).alias("rest")))
    rest = sums.groupBy(group).agg(F.sum("rest").alias("other_count"))
    return top.join(rest, group).select(group, "rank", "value", "n", "other_count")


def folded_top(counts: DataFrame, k: int, group: str = "column") -> DataFrame:
    """Top ``k`` values plus one row for the folded rest when there is a rest."""
    both = top_with_rest(counts, k, group)
    rest = (
        both.where((F.col("rank") == 1) & (F.col("other_count") > 0))
        .select(
            group,
            F.lit(k + 1).alias("rank"),
            F.format_string("other (%d)", "other_count").alias("value"),
            F.col("other_count").alias("n"),
        )
    )
    return both.select(group, "rank", "value", "n").unionByName(rest)


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, the smallest one on ties."""
    best = F.min_by("value", F.struct((-F.col("n")).alias("by"), F.col("value")))
    return counts.groupBy("column").agg(best.alias("mode"))
