"""The model that confirms or corrects the rules: a forest over profile vectors."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.vectors import FEATURE_ORDER, order_fingerprint
from tableprobe.operators.evaluation import BINARY, MULTICLASS, REGRESSION, confusion, fold_metrics, over_folds
from tableprobe.operators.preparation import Scale, apply_scale, class_weights
from tableprobe.operators.sampling import FOLDS, stratified_folds
from tableprobe.plans.catalog import feature_names, feature_table, fit_feature_scale
from tableprobe.session import cut_lineage

# Hyper-parameters of the forest.
TREES = 200
DEPTH = 10
MIN_LEAF = 2
SEED = 42

TASKS = [BINARY, MULTICLASS, REGRESSION]


@dataclass
class MetaModel:
    forest: RandomForestClassificationModel
    scale: Scale
    classes: list[str]
    metrics: DataFrame  # model, metric, mean, std
    confusion: DataFrame  # label, prediction, n (out of fold, task names)
    importances: DataFrame  # feature, importance
    n_rows: int


def training_rows(*sources: DataFrame) -> DataFrame:
    """All training profiles together; clustering rows are left out."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.where(F.col("task_type_code").isin(TASKS))


def _vectors(features: DataFrame, scale: Scale) -> DataFrame:
    scaled = apply_scale(features, scale)
    return VectorAssembler(inputCols=feature_names(), outputCol="features").transform(scaled)


def _forest() -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=MIN_LEAF, weightCol="weight", seed=SEED
    )


def _weighted(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(class_weights(df, "label")), "label")  # three classes


def train_meta_model(profiles: DataFrame, folds: int = FOLDS, fit_once: bool = False) -> MetaModel:
    """Cross-validate and train on profile rows with ``dataset`` and ``task_type_code``."""
    rows = training_rows(profiles)
    classes = sorted(r[0] for r in rows.select("task_type_code").distinct().collect())
    code = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    table = feature_table(rows).withColumn("label", code[F.col("task_type_code")])
    data = cut_lineage(stratified_folds(table, "task_type_code", "dataset", folds))
    spark = profiles.sparkSession
    whole = fit_feature_scale(data)
    predictions = None
    for fold in range(folds):
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        scale = whole if fit_once else fit_feature_scale(train)
        model = _forest().fit(_weighted(_vectors(train, scale)))
        part = model.transform(_vectors(test, scale)).select(
            F.lit("meta").alias("model"), F.lit(fold).alias("fold"), "label", "prediction"
        )
        predictions = part if predictions is None else predictions.unionByName(part)
    predictions = cut_lineage(predictions)
    metrics = over_folds(fold_metrics(predictions, MULTICLASS, ["model", "fold"]))
    names = F.array(*[F.lit(c) for c in classes])
    named = predictions.select(
        names[F.col("label").cast("int")].alias("label"), names[F.col("prediction").cast("int")].alias("prediction")
    )
    forest = _forest().fit(_weighted(_vectors(data, whole)))
    weights = forest.featureImportances.toArray()
    importances = spark.createDataFrame(
        [(n, float(w)) for n, w in zip(FEATURE_ORDER, weights)], "feature string, importance double"
    )
    return MetaModel(forest, whole, classes, metrics, confusion(named), importances, data.count())


def score(profiles: DataFrame, model: MetaModel) -> DataFrame:
    """``(dataset, ml_class, ml_confidence, ml_probabilities)`` for every profile row."""
    scored = model.forest.transform(_vectors(feature_table(profiles), model.scale))
    p = vector_to_array(F.col("probability"))
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_max(p)
    return scored.select(
        "dataset",
        names[(F.array_position(p, best) - 1).cast("int")].alias("ml_class"),
        best.alias("ml_confidence"),
        F.map_from_arrays(names, p).alias("ml_probabilities"),
    )


PARTS = ("metrics", "confusion", "importances")


def save_model(model: MetaModel, folder: str) -> int:
    """Store a model below ``folder`` and give back its version, 1, 2, …

    Forest and tables go to a place of their own first. The row that names this place is written last: a version
    exists once it can be read whole, and what an interrupted save left behind is never read.
    """
    spark = model.metrics.sparkSession
    place = f"{folder}/models/{uuid4().hex}"
    model.forest.write().save(f"{place}/forest")
    for part in PARTS:
        getattr(model, part).write.parquet(f"{place}/{part}")
    known = versions(spark, folder)
    version = 1 + ((known.agg(F.max("version")).first()[0] or 0) if known is not None else 0)
    facts = [(version, place, model.classes, model.scale.mean, model.scale.std, model.n_rows)]
    spark.createDataFrame(
        facts, "version int, place string, classes array<string>, mean map<string,double>, std map<string,double>, n_rows long"
    ).withColumn("vector_order", order_fingerprint()).write.mode("append").parquet(f"{folder}/versions")
    return version


def versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """The published models below ``folder``, one row each; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{folder}/versions")


def load_model(spark: SparkSession, folder: str, version: int | None = None) -> MetaModel:
    """A stored model, the newest unless a version is named; one of another feature order is refused."""
    known = versions(spark, folder)
    wanted = None if known is None else known if version is None else known.where(F.col("version") == version)
    row = None if wanted is None else wanted.withColumn("fits", F.col("vector_order") == order_fingerprint()).orderBy(F.desc("version"), "place").first()
    if row is None:
        raise ValueError(f"no model {'' if version is None else f'of version {version} '}below {folder}")
    if not row.fits:
        raise ValueError(f"model {row.version} was trained on another feature order; train it again")
    tables = {part: spark.read.parquet(f"{row.place}/{part}") for part in PARTS}
    forest = RandomForestClassificationModel.load(f"{row.place}/forest")
    return MetaModel(forest, Scale(row["mean"], row["std"]), row.classes, n_rows=row.n_rows, **tables)
