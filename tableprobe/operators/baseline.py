"""Cross-validated baseline models with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.columns import column_groups, finite, nan_to_null, ref
from tableprobe.operators import forest as forests
from tableprobe.operators import ridge as ridges
from tableprobe.operators.evaluation import BINARY, MULTICLASS, REGRESSION, fold_metrics, over_folds
from tableprobe.operators.preparation import (
    Encoder,
    cardinality,
    class_codes,
    class_weights,
    fill_values,
    fit_scale,
    impute,
    modelling_columns,
    prepared,
)
from tableprobe.operators.sampling import FOLDS, plain_folds, random_sample, stratified_folds, stratified_sample
from tableprobe.session import cut_lineage, stored, together

# Hyper-parameters of the baselines.
LOGISTIC_ITERATIONS = 200
RIDGE_ALPHA = 1.0
TREES = 50
DEPTH = 5
SEED = 42

# Above so many rows a regression is trained by scans: Spark ML's bagged rows no longer stay in memory.
ROWS_IN_MEMORY = 1_000_000
# The most features whose products are added up per fold.
NORMAL_FEATURES = 500

NO_BASELINE = ("CLUSTERING", "NOT_READY")


@dataclass
class Baseline:
    """What a baseline run gives back; the tables are DataFrames."""

    models: list[str] = field(default_factory=list)
    metrics: DataFrame | None = None  # model, metric, mean, std
    per_fold: DataFrame | None = None  # model, fold, metric, value
    importances: DataFrame | None = None  # feature, importance
    predictions: DataFrame | None = None  # model, fold, label, prediction, score
    excluded: list[str] = field(default_factory=list)
    n_rows: int = 0
    n_features: int = 0
    note: str = ""


METRIC_FIELDS = "model string, metric string, mean double, std double"


def no_baseline(spark: SparkSession) -> Baseline:
    return Baseline(
        metrics=spark.createDataFrame([], METRIC_FIELDS),
        importances=spark.createDataFrame([], "feature string, importance double"),
        note="No baseline for this kind of task; consider KMeans or DBSCAN.",
    )


def classifiers() -> list[str]:
    return ["logistic_regression", "random_forest"]


def regressors() -> list[str]:
    return ["ridge", "random_forest"]


def _estimator(name: str, task: str, train: DataFrame):
    if task == REGRESSION:
        if name == "ridge":
            row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("sd")).first()
            # The solver divides the label by its sample deviation, the penalty follows.
            return LinearRegression(
                solver="l-bfgs",
                elasticNetParam=0.0,
                standardization=False,
                regParam=RIDGE_ALPHA * (row["sd"] or 0.0) / max(row["n"], 1),
                maxIter=500,
                tol=1e-10,
            )
        return RandomForestRegressor(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", seed=SEED)
    if name == "logistic_regression":
        return LogisticRegression(
            maxIter=LOGISTIC_ITERATIONS,
            weightCol="weight",
            regParam=1.0 / max(train.count(), 1),
            standardization=False,
        )
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED)


def train_baseline(
    df: DataFrame,
    target: str,
    task: str,
    key: str,
    leakage: list[str] | None = None,
    ratios: dict[str, float] | None = None,
    max_rows: int | None = None,
    fit_once: bool = False,
    folds: int = FOLDS,
) -> Baseline:
    """Two models, ``folds`` folds, all metrics per fold, importances from a final forest.

    All rows are used unless ``max_rows`` asks for a (stratified) training sample. Medians,
    modes and scales are learned on the training folds; ``fit_once`` learns them once on
    everything.
    """
    spark = df.sparkSession
    if task in NO_BASELINE:
        return no_baseline(spark)
    if task not in (BINARY, MULTICLASS, REGRESSION):
        raise NotImplementedError(f"no baseline for task {task!r}")
    if task == REGRESSION and max_rows is None and _known(df, target).count() > ROWS_IN_MEMORY:
        return _regression_by_scans(df, target, key, leakage or [], ratios, fit_once, folds)
    frame, columns = prepared(df, target, key, leakage, ratios)
    if max_rows is not None and frame.count() > max_rows:
        frame = (
            random_sample(frame, key, max_rows)
            if task == REGRESSION
            else stratified_sample(frame, target, key, max_rows)
        )
    numeric, categorical = columns["numeric"], columns["categorical"]
    frame = frame.select(
        ref(key),
        ref(target).alias("__target"),
        *[ref(c).cast("double").alias(c) for c in numeric],
        *[ref(c).cast("string").alias(c) for c in categorical],
    )
    if task == REGRESSION:
        labelled = plain_folds(frame, key, folds).withColumn("label", ref("__target").cast("double"))
    else:
        codes = class_codes(frame, "__target")
        split = stratified_folds(frame, "__target", key, folds)
        labelled = split.join(
            F.broadcast(codes.select(F.col("label").alias("__class"), F.col("code").cast("double").alias("label"))),
            ref("__target") == F.col("__class"),
        ).drop("__class")
    data = cut_lineage(labelled.drop("__target"))
    n_rows = data.count()
    encoder = Encoder(numeric, categorical).fit_levels(data)
    whole = (fill_values(data, numeric, categorical), None)
    whole = (whole[0], fit_scale(impute(data, whole[0]), numeric))
    names = regressors() if task == REGRESSION else classifiers()

    def run_fold(fold: int) -> DataFrame:
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        fills = whole[0] if fit_once else fill_values(train, numeric, categorical)
        scale = whole[1] if fit_once else fit_scale(impute(train, fills), numeric)
        train_x = _weighted(encoder.vectors(impute(train, fills), scale), task).persist()
        test_x = encoder.vectors(impute(test, fills), scale)
        parts = []
        for name in names:
            model = _estimator(name, task, train_x).fit(train_x)
            scored = model.transform(test_x)
            score = (
                F.lit(None).cast("double")
                if task == REGRESSION
                else F.element_at(vector_to_array("probability"), -1)
            )
            parts.append(
                scored.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "label", "prediction", score.alias("score"))
            )
        train_x.unpersist()
        return reduce(DataFrame.unionByName, parts)

    # The folds are independent, so a few of them are fitted side by side.
    scored = together({f"fold {i}": (lambda i=i: run_fold(i)) for i in range(folds)}, at_once=3)
    predictions = cut_lineage(reduce(DataFrame.unionByName, scored.values()))
    per_fold = fold_metrics(predictions, task, ["model", "fold"], positive=1.0)

    final = _weighted(encoder.vectors(impute(data, whole[0]), whole[1]), task)
    forest = _estimator("random_forest", task, final).fit(final)
    weights = forest.featureImportances.toArray()
    importances = spark.createDataFrame(
        [(n, float(w)) for n, w in zip(encoder.names, weights)], "feature string, importance double"
    )
    return Baseline(
        models=names,
        metrics=over_folds(per_fold),
        per_fold=per_fold,
        importances=importances,
        predictions=predictions,
        excluded=list(leakage or []),
        n_rows=n_rows,
        n_features=len(encoder.names),
    )


def _weighted(df: DataFrame, task: str) -> DataFrame:
    """Balanced class weights of the rows at hand; none for regression."""
    if task == REGRESSION:
        return df
    return df.join(F.broadcast(class_weights(df, "label")), "label")  # one row per class, at most MAX_LEVELS


def _known(df: DataFrame, target: str) -> DataFrame:
    return nan_to_null(df).where(ref(target).isNotNull())


def _regression_by_scans(
    df: DataFrame, target: str, key: str, leakage: list[str], ratios: dict[str, float] | None, fit_once: bool, folds: int
) -> Baseline:
    """Both regressors on a table of any size.

    The table is written once, without its key; folds, medians, modes and scales are those of :func:`train_baseline`. One scan
    adds up what the ridges of all folds need, the forests of all folds share a scan per depth.
    """
    spark = df.sparkSession
    clean = plain_folds(_known(df, target).withColumn("__target", ref(target)), key, folds)
    out = {target, key, "__target", "fold", *leakage}
    groups = {kind: [c for c in names if c not in out] for kind, names in column_groups(df).items()}
    table = stored(
        clean.select(
            F.monotonically_increasing_id().alias("__row"),
            "fold",
            ref("__target").cast("double").alias("__target"),
            *[ref(c).cast("double").alias(c) for c in groups["numeric"]],
            *[ref(c).cast("string").alias(c) for c in groups["categorical"]],
        )
    )
    if ratios is None:
        ratios = cardinality(table, groups["categorical"])
    columns = modelling_columns(df.select(*[ref(c) for c in df.columns if c != "fold"]), target, leakage, ratios, key)
    numeric, categorical = columns["numeric"], columns["categorical"]
    encoder = Encoder(numeric, categorical).fit_levels(table)
    labels = dict(zip(categorical, encoder.indexer.labelsArray)) if categorical else {}
    coded = encoder.indexer.transform(table) if categorical else table
    values = [finite(ref(c)) for c in numeric]
    values += [F.when(ref(c).isNotNull(), F.col(f"__i{k}")) for k, c in enumerate(categorical)]
    data = coded.select(F.col("__row").alias("row"), "fold", F.col("__target").alias("label"), *[v.alias(f"x{i}") for i, v in enumerate(values)])
    design, n_rows = ridges.design_of(data, len(numeric), [len(labels[c]) for c in categorical])
    names = numeric + categorical
    gaps = [names[i] for i in design.gaps]

    def learned(rows: DataFrame) -> dict:
        """Fill values; they are of use only in columns with gaps."""
        fills = {**dict.fromkeys(numeric, 0.0), **dict.fromkeys(categorical, "MISSING")}
        if gaps:
            fills |= fill_values(rows, [c for c in numeric if c in gaps], [c for c in categorical if c in gaps])
        return fills

    whole = learned(table)
    fills = {f: whole if fit_once else learned(table.where(F.col("fold") != f)) for f in range(folds)}

    def numbers(some: dict) -> list[float]:
        """Fill values with levels as numbers; a value that is no level has the number after the last."""
        return [some[c] for c in numeric] + [labels[c].index(some[c]) if some[c] in labels[c] else len(labels[c]) for c in categorical]

    if len(encoder.names) <= NORMAL_FEATURES:
        sums = ridges.sums_of_folds(data, design, folds)
        total = sums.sum(axis=0)
        weights = {
            f: ridges.solve(design, total - sums[f], total if fit_once else total - sums[f], numbers(fills[f]), RIDGE_ALPHA) for f in fills
        }
        lines = ridges.predictions(data, design, weights)
    else:
        lines = _ridge_by_steps(table.withColumnRenamed("__target", "label"), encoder, numeric, fills, whole if fit_once else None)

    layout = forests.laid_out(
        forests.numeric_columns(table, numeric) + [forests.Column(c, levels=len(labels[c])) for c in categorical]
    )
    rows = stored(forests.with_cells(data, layout))

    def codes(some: dict) -> list[int]:
        return [c.code_of(v) for c, v in zip(layout.columns, numbers(some))]

    grown = forests.grow(rows, layout, {f: codes(fills[f]) for f in fills} | {None: codes(whole)}, TREES, DEPTH, SEED)
    predictions = reduce(
        DataFrame.unionByName,
        [
            found.select(F.lit(name).alias("model"), "fold", "label", "prediction", F.lit(None).cast("double").alias("score"))
            for name, found in zip(regressors(), (lines, forests.predictions(rows, layout, grown)))
        ],
    )
    per_fold = cut_lineage(fold_metrics(predictions, REGRESSION, ["model", "fold"], positive=1.0))
    shares = forests.importances(grown[None])
    return Baseline(
        models=regressors(),
        metrics=over_folds(per_fold),
        per_fold=per_fold,
        importances=spark.createDataFrame([(n, float(w)) for n, w in zip(encoder.names, shares)], "feature string, importance double"),
        predictions=predictions,
        excluded=list(leakage),
        n_rows=n_rows,
        n_features=len(encoder.names),
    )


def _ridge_by_steps(data: DataFrame, encoder: Encoder, numeric: list[str], fills: dict[int, dict], whole: dict | None) -> DataFrame:
    """``(fold, label, prediction)`` by Spark ML's solver, where products of all features are too many."""
    scale = fit_scale(impute(data, whole), numeric) if whole else None

    def run_fold(fold: int) -> DataFrame:
        train, test = impute(data.where(F.col("fold") != fold), fills[fold]), impute(data.where(F.col("fold") == fold), fills[fold])
        of = scale or fit_scale(train, numeric)
        train_x = encoder.vectors(train, of).select("label", "features").persist()
        model = _estimator("ridge", REGRESSION, train_x).fit(train_x)
        train_x.unpersist()
        return model.transform(encoder.vectors(test, of)).select("fold", "label", "prediction")

    parts = together({f"fold {f}": (lambda f=f: run_fold(f)) for f in fills}, at_once=3)
    return reduce(DataFrame.unionByName, parts.values())
