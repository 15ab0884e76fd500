"""Metrics of stored predictions, per fold and over folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.session import cut_lineage

SCORES_PER_PIECE = 1_000_000

BINARY = "BINARY_CLASSIFICATION"
MULTICLASS = "MULTICLASS_CLASSIFICATION"
REGRESSION = "REGRESSION"


def confusion(predictions: DataFrame) -> DataFrame:
    """``(label, prediction, n)`` with the pairs that never occur left out."""
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, labels: list) -> DataFrame:
    """One row per label and one field per predicted label, in the given order."""
    wide = predictions.groupBy("label").pivot("prediction", labels).count()
    return wide.na.fill(0).orderBy("label")


def _long(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(keys, metrics, "metric", "value")


def binary_metrics(predictions: DataFrame, positive, keys: list[str]) -> DataFrame:
    """accuracy, precision, recall, f1 per group of ``keys``; a zero denominator gives 0."""
    said, true = F.col("prediction") == F.lit(positive), F.col("label") == F.lit(positive)
    tp = F.count(F.when(said & true, 1))
    wide = predictions.groupBy(*keys).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, F.count(F.when(said, 1))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.count(F.when(true, 1))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, F.count(F.when(said, 1)) + F.count(F.when(true, 1))), F.lit(0.0)).alias("f1"),
    )
    return _long(wide, keys, ["accuracy", "precision", "recall", "f1"])


def multiclass_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, f1_macro, f1_weighted per group, from label/prediction counts."""
    counts = predictions.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"),
                         F.lit(0).cast("long").alias("hit")),
            )
        ),
    )
    per_class = sides.groupBy(*keys, "cls").agg(F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("true") + F.col("said")), F.lit(0.0))
    wide = per_class.withColumn("f1", f1).groupBy(*keys).agg(
        (F.sum("hit") / F.sum("true")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("true")) / F.sum("true")).alias("f1_weighted"),
    )
    return _long(wide, keys, ["accuracy", "f1_macro", "f1_weighted"])


def regression_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """mae, rmse and r2 per group."""
    error = F.col("label") - F.col("prediction")
    wide = predictions.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop("label"))).alias("r2"),
    )
    return _long(wide, keys, ["mae", "rmse", "r2"])


def roc_auc(predictions: DataFrame, positive, keys: list[str]) -> DataFrame:
    """Area under the ROC curve per group, exact, ties counted half.

    Rows are first counted per distinct score. Spark deals these out by ranges of group and score,
    and the ranges are stored, so that both readings of them agree. The running count of negatives
    is built from the sums of the ranges and then inside each range: no group is sorted in one task,
    and no row is held against a list of boundaries.
    """
    is_positive = F.col("label") == F.lit(positive)
    scores = predictions.groupBy(*keys, F.col("score").cast("double").alias("score")).agg(
        F.count(F.when(is_positive, 1)).alias("pos"), F.count(F.when(~is_positive, 1)).alias("neg")
    )
    scores = cut_lineage(scores)
    at_once = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(at_once, math.ceil(scores.count() / SCORES_PER_PIECE))
    ranges = scores.repartitionByRange(wanted, *keys, "score") if keys else scores.repartitionByRange(wanted, "score")
    pieces = cut_lineage(ranges.withColumn("piece", F.spark_partition_id()))
    sums = pieces.groupBy(*keys, "piece").agg(F.sum("neg").alias("piece_neg"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "piece", F.coalesce(F.sum("piece_neg").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys, "piece").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("start") + F.coalesce(F.col("inner"), F.lit(0))
    return (
        pieces.withColumn("inner", F.sum("neg").over(inside))
        .join(starts, [*keys, "piece"])
        .groupBy(*keys)
        .agg(
            F.try_divide(
                F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg")
            ).alias("value")
        )
        .select(*keys, F.lit("roc_auc").alias("metric"), "value")
    )


def fold_metrics(predictions: DataFrame, task: str, keys: list[str], positive=None) -> DataFrame:
    """The metrics of a task per group of ``keys``: ``(…keys, metric, value)``."""
    if task == BINARY:
        return binary_metrics(predictions, positive, keys).unionByName(roc_auc(predictions, positive, keys))
    if task == MULTICLASS:
        return multiclass_metrics(predictions, keys)
    if task == REGRESSION:
        return regression_metrics(predictions, keys)
    raise NotImplementedError(f"no metrics for task {task!r}")


def over_folds(per_fold: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the folds."""
    return per_fold.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def class_distribution(table: DataFrame, label: str) -> DataFrame:
    return table.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def top_importances(importances: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest importances of each model with the bar width in percent of its largest.

    A table without a ``model`` column is one model.
    """
    model = [F.col("model")] if "model" in importances.columns else [F.lit(1)]
    order = Window.partitionBy(*model).orderBy(F.desc("importance"), F.asc("feature"))
    top = importances.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")
    share = F.try_divide(F.col("importance"), F.max("importance").over(Window.partitionBy(*model)))
    return top.withColumn("width_pct", F.coalesce(100 * share, F.lit(0.0)))
