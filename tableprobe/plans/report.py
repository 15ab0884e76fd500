"""The tables behind a report: charts, target, summary, baseline, result and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.scalars import estimated_distinct, highlight_duplicates, highlight_missing, is_id_like
from tableprobe.operators.categorical import folded_top
from tableprobe.operators.evaluation import top_importances
from tableprobe.operators.service import page, severity_rank

# How many charts and bars a report shows.
NUMERIC_CHARTS = 10
CATEGORY_CHARTS = 5
BARS = 15


def _first_columns(columns: DataFrame, kind: str, limit: int) -> DataFrame:
    """The first columns of a kind in table order, per dataset where there are several."""
    dataset = [F.col("dataset")] if "dataset" in columns.columns else [F.lit(1)]
    order = Window.partitionBy(*dataset).orderBy("position")
    ranked = columns.where(F.col("kind") == kind).withColumn("__k", F.row_number().over(order))
    return ranked.where(F.col("__k") <= limit).drop("__k")


def numeric_charts(histograms: DataFrame, columns: DataFrame, limit: int = NUMERIC_CHARTS) -> DataFrame:
    """Histogram rows of the first ``limit`` numeric columns of each dataset in table order."""
    first = _first_columns(columns, "numeric", limit)
    return histograms.join(first.select("dataset", "column"), ["dataset", "column"], "left_semi")


def category_charts(
    counts: DataFrame, columns: DataFrame, n_rows: Column, limit: int = CATEGORY_CHARTS, bars: int = BARS
) -> tuple[DataFrame, DataFrame]:
    """Bars of the first ``limit`` category columns, and one line for each id-like one."""
    first = _first_columns(columns, "categorical", limit)
    judged = first.withColumn("id_like", is_id_like(F.col("cardinality_ratio"), n_rows))
    # Columns of several datasets may share a name: bars are then per dataset and column.
    keys = [c for c in ("dataset", "column") if c in counts.columns and c in judged.columns]
    bars_of = judged.where(~F.col("id_like")).select(*keys)
    lines = judged.where("id_like").select(
        *keys, estimated_distinct(F.col("cardinality_ratio"), n_rows).alias("n_unique")
    )
    shown = counts.join(bars_of, keys, "left_semi")
    if len(keys) == 1:
        return folded_top(shown, bars), lines
    both = folded_top(shown.withColumn("place", F.struct(*keys)), bars, "place")
    return both.select("place.*", "rank", "value", "n"), lines


def target_chart(classes: DataFrame) -> DataFrame:
    """Class counts, largest first."""
    return classes.orderBy(F.desc("n"), "label")


def summary(table: DataFrame) -> DataFrame:
    """Sizes, missing shares and target facts, with the highlight marks."""
    return table.select(
        "dataset",
        "n_rows",
        "n_cols",
        "total_missing_pct",
        "max_col_missing_pct",
        "duplicate_rows_pct",
        "target_kind",
        "target_n_unique",
        "target_imbalance_ratio",
        "target_class_entropy",
        "target_skewness",
        highlight_missing(F.col("total_missing_pct")).alias("mark_missing"),
        highlight_duplicates(F.col("duplicate_rows_pct")).alias("mark_duplicates"),
    )


def baseline_table(metrics: DataFrame) -> DataFrame:
    """One row per model and one text field ``mean ± std`` per metric."""
    text = F.format_string("%.3f ± %.3f", "mean", "std")
    return metrics.groupBy("model").pivot("metric").agg(F.first(text)).orderBy("model")


def importance_table(importances: DataFrame) -> DataFrame:
    return top_importances(importances)


def result_page(results: DataFrame, flags: DataFrame) -> DataFrame:
    """Result rows with their flags, one row per flag, worst first; a result without flags stays."""
    ranked = flags.select("dataset", severity_rank(F.col("severity")).alias("severity_rank"), "severity", "rule_code", "column", "message")
    joined = results.join(ranked, "dataset", "left")
    return joined.orderBy("dataset", F.asc_nulls_last("severity_rank"), "rule_code", "column")


def history(runs: DataFrame, datasets: DataFrame, results: DataFrame, number: int, size: int) -> DataFrame:
    """A page of runs, newest first, with the dataset name and the recommended task if any.

    The page is cut first; both lookups are then filtered by the few keys of the page before
    they are joined, so neither large table is shuffled.
    """
    order = [F.desc("started_at"), F.asc("analysis_id")]
    shown = page(runs, order, number, size)

    def looked_up(table: DataFrame, key: str) -> DataFrame:
        keys = F.broadcast(shown.select(key).distinct())  # at most one page of keys
        return table.join(keys, key, "left_semi")

    joined = shown.join(looked_up(datasets, "dataset_id"), "dataset_id", "left")
    return joined.join(looked_up(results, "analysis_id"), "analysis_id", "left").orderBy(*order)
