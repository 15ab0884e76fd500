"""Queries for baselines, stored predictions and the meta model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.operators import evaluation, preparation
from tableprobe.operators.baseline import train_baseline
from tableprobe.operators.evaluation import BINARY, MULTICLASS, REGRESSION
from tableprobe.plans.catalog import embed, load_catalog, usable
from tableprobe.plans.fleet import Source, profile_fleet
from tableprobe.plans.meta_model import load_model, save_model, score, train_meta_model
from tableprobe.plans.profile import profile
from tableprobe.plans.recommend import decide, hybrid
from tableprobe.plans.report import baseline_table, importance_table
from tableprobe.queries.registry import Tables, query, r, scratch, union_all
from tableprobe.queries.statistics import gappy

# Stored predictions made from the orders: the fold by key, the label and a prediction that
# follow from the status, the price and the customer.
_STORED = """(SELECT 'm' AS model, (o_orderkey % 5)::INTEGER AS fold, (o_orderstatus = 'F')::INTEGER AS label,
  (o_totalprice * (CASE WHEN o_orderstatus = 'F' THEN 1.2 ELSE 1 END) > 240000)::INTEGER AS prediction,
  floor(o_totalprice * (CASE WHEN o_orderstatus = 'F' THEN 1.2 ELSE 1 END) / 1000) AS score,
  o_orderstatus AS many, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN o_orderstatus ELSE 'O' END AS guess,
  o_totalprice AS y, o_totalprice * 0.9 + o_custkey AS y_hat FROM orders)"""


def stored(t: Tables) -> DataFrame:
    boosted = F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", 1.2).otherwise(1.0)
    return t.orders.select(
        F.lit("m").alias("model"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (boosted > 240000).cast("int").alias("prediction"),
        F.floor(boosted / 1000).alias("score"),
        F.col("o_orderstatus").alias("many"),
        F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 150000, F.col("o_orderstatus")).otherwise("O").alias("guess"),
        F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("y_hat"),
    )


@query("confusion_counts", "A26", f"SELECT many AS label, guess AS prediction, count(*) AS n FROM {_STORED} GROUP BY ALL")
def confusion_counts(t: Tables) -> DataFrame:
    return evaluation.confusion(stored(t).select(F.col("many").alias("label"), F.col("guess").alias("prediction")))


@query(
    "confusion_matrix",
    "A26",
    "SELECT many AS label, " + ", ".join(f"count(*) FILTER (guess = '{c}') AS {c}" for c in "FOP") + f" FROM {_STORED} GROUP BY 1",
)
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluation.confusion_matrix(stored(t).select(F.col("many").alias("label"), F.col("guess").alias("prediction")), list("FOP"))


_BINARY_SQL = union_all(
    [f"SELECT model, fold, '{m}' AS metric, {r(e)} AS value FROM {_STORED} GROUP BY ALL" for m, e in (
        ("accuracy", "avg((label = prediction)::INTEGER)"),
        ("precision", "count(*) FILTER (label = 1 AND prediction = 1) / nullif(count(*) FILTER (prediction = 1), 0)"),
        ("recall", "count(*) FILTER (label = 1 AND prediction = 1) / nullif(count(*) FILTER (label = 1), 0)"),
        ("f1", "2 * count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (prediction = 1) + count(*) FILTER (label = 1))"),
    )]
    + [f"""SELECT model, fold, 'roc_auc', {r("(sum(rk) FILTER (label = 1) - p * (p + 1) / 2.0) / (p * ng)")} FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk,
      sum(label) OVER (PARTITION BY fold) AS p, sum(1 - label) OVER (PARTITION BY fold) AS ng FROM {_STORED}) GROUP BY model, fold, p, ng"""]
)


@query("binary_metrics", "A27", _BINARY_SQL)
def binary_metrics(t: Tables) -> DataFrame:
    return evaluation.fold_metrics(stored(t), BINARY, ["model", "fold"], positive=1)


_MULTI_SQL = f"""WITH c AS (SELECT fold, cls, sum(t)::DOUBLE AS t, sum(s)::DOUBLE AS s, sum(h)::DOUBLE AS h FROM (
  SELECT fold, many AS cls, 1 AS t, 0 AS s, (many = guess)::INTEGER AS h FROM {_STORED} UNION ALL SELECT fold, guess, 0, 1, 0 FROM {_STORED}) GROUP BY ALL)
  SELECT 'm' AS model, fold, 'accuracy' AS metric, {r('sum(h) / sum(t)')} AS value FROM c GROUP BY fold
  UNION ALL SELECT 'm', fold, 'f1_macro', {r('avg(2 * h / (t + s))')} FROM c GROUP BY fold
  UNION ALL SELECT 'm', fold, 'f1_weighted', {r('sum(t * 2 * h / (t + s)) / sum(t)')} FROM c GROUP BY fold"""


@query("multiclass_metrics", "A27", _MULTI_SQL)
def multiclass_metrics(t: Tables) -> DataFrame:
    rows = stored(t).select("model", "fold", F.col("many").alias("label"), F.col("guess").alias("prediction"))
    return evaluation.fold_metrics(rows, MULTICLASS, ["model", "fold"])


_REGRESSION_SQL = union_all(
    [f"SELECT model, fold, '{m}' AS metric, {e} AS value FROM {_STORED} GROUP BY ALL" for m, e in (
        ("mae", "avg(abs(y - y_hat))"), ("rmse", "sqrt(avg(pow(y - y_hat, 2)))"), ("r2", "1 - avg(pow(y - y_hat, 2)) / var_pop(y)"))]
)


@query("regression_metrics", "A28", f"SELECT model, fold, metric, {r('value')} AS value FROM ({_REGRESSION_SQL})")
def regression_metrics(t: Tables) -> DataFrame:
    rows = stored(t).select("model", "fold", F.col("y").alias("label"), F.col("y_hat").alias("prediction"))
    return evaluation.fold_metrics(rows, REGRESSION, ["model", "fold"])


@query(
    "metrics_over_folds",
    "A29 P4",
    f"SELECT model, metric, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM ({_REGRESSION_SQL}) GROUP BY ALL",
)
def metrics_over_folds(t: Tables) -> DataFrame:
    rows = stored(t).select("model", "fold", F.col("y").alias("label"), F.col("y_hat").alias("prediction"))
    return evaluation.over_folds(evaluation.fold_metrics(rows, REGRESSION, ["model", "fold"]))


@query(
    "modelling_numbers",
    "L1 F4 F5 M3 M6",
    """WITH s AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity, coalesce(tax_or_null, (SELECT median(tax_or_null) FROM g)) AS tax FROM g)
    SELECT count(*) AS n, """.replace("FROM g", "FROM (SELECT *, nullif(l_tax, 0) AS tax_or_null FROM lineitem)")
    + f"{r('avg((l_quantity - mq) / sq)')} AS mean_quantity, {r('max((l_quantity - mq) / sq)')} AS max_quantity, {r('max((tax - mt) / st)')} AS max_tax, {r('min((tax - mt) / st)')} AS min_tax"
    + " FROM s, (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(tax) AS mt, stddev_pop(tax) AS st FROM s)",
)
def modelling_numbers(t: Tables) -> DataFrame:
    """Imputed and standardised numbers of a modelling table."""
    data = gappy(t).select("l_orderkey", "l_extendedprice", "l_quantity", "tax_or_null", "l_shipdate")
    frame, columns = preparation.prepared(data, "l_extendedprice", "l_orderkey")
    filled = preparation.impute(frame, preparation.fill_values(frame, columns["numeric"], []))
    scaled = preparation.apply_scale(filled, preparation.fit_scale(filled, columns["numeric"]))
    return scaled.agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity"), F.max("l_quantity").alias("max_quantity"),
        F.max("tax_or_null").alias("max_tax"), F.min("tax_or_null").alias("min_tax"),
    )


def labelled_features(t: Tables) -> DataFrame:
    """Documents with a quality label and simple numbers of their text."""
    text = F.col("text")
    joined = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    words = F.size(F.split(text, r"\s+"))
    return joined.select(
        "doc_id", "quality", "lang", "source", "n_chars", words.alias("n_words"),
        (F.length(F.regexp_replace(text, r"[^\d]", "")) / F.greatest(F.length(text), F.lit(1))).alias("digit_share"),
    )


@query("binary_baseline", "L1 L2 L3 L6 A27 A29 M4 M12 W4 T10")
def binary_baseline(t: Tables) -> DataFrame:
    """Two classifiers, five stratified folds, on the labelled documents."""
    return train_baseline(labelled_features(t), "quality", BINARY, "doc_id").metrics


@query("multiclass_baseline", "L2 L3 L6 A27 M5")
def multiclass_baseline(t: Tables) -> DataFrame:
    features = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return train_baseline(features, "label", MULTICLASS, "vec_id").metrics


@query("regression_baseline", "L4 L5 L6 L7 T10 P4")
def regression_baseline(t: Tables) -> DataFrame:
    """Importances of the final forest for the price of a line."""
    lines = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size"), "l_partkey")
    keyed = lines.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("id"),
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size", "l_returnflag",
    )
    found = train_baseline(keyed, "l_extendedprice", REGRESSION, "id")
    table = baseline_table(found.metrics).select(F.col("model").alias("name"), F.concat_ws(" | ", "mae", "rmse", "r2").alias("value"))
    best = importance_table(found.importances).select(F.col("feature").alias("name"), F.format_string("%.4f", "importance").alias("value"))
    return table.unionByName(best)


@query("no_baseline", "L8", "SELECT 'CLUSTERING' AS task, 0::BIGINT AS n_metrics, true AS noted, count(*) AS n_rows FROM region")
def no_baseline(t: Tables) -> DataFrame:
    found = train_baseline(t.region, "r_name", "CLUSTERING", "r_regionkey")
    return t.region.agg(
        F.lit("CLUSTERING").alias("task"), F.lit(found.metrics.count()).cast("long").alias("n_metrics"),
        F.lit(bool(found.note)).alias("noted"), F.count(F.lit(1)).alias("n_rows"),
    )


# ---- the meta model -------------------------------------------------------------------


def fleet_sources(t: Tables) -> list[Source]:
    """Candidate targets of the given tables with the task each of them is known to be."""
    def source(table: str, target: str, task: str) -> Source:
        return Source(f"{table}.{target}", lambda: getattr(t, table), target, task)

    halves = [
        Source("orders.is_open", lambda: t.orders.withColumn("is_open", F.col("o_orderstatus") == "O").drop("o_orderstatus"), "is_open", BINARY),
        Source("part.is_big", lambda: t.part.withColumn("is_big", (F.col("p_size") > 25).cast("int")), "is_big", BINARY),
    ]
    return halves + [
        source("labels", "toxic", BINARY), source("labels", "quality", BINARY), source("lineitem", "l_linestatus", BINARY),
        source("conversations", "role", BINARY),
        source("orders", "o_orderstatus", MULTICLASS), source("orders", "o_orderpriority", MULTICLASS), source("lineitem", "l_returnflag", MULTICLASS),
        source("events", "event_type", MULTICLASS), source("customer", "c_mktsegment", MULTICLASS),
        source("orders", "o_totalprice", REGRESSION), source("lineitem", "l_extendedprice", REGRESSION), source("customer", "c_acctbal", REGRESSION),
        source("part", "p_retailprice", REGRESSION), source("events", "value", REGRESSION),
    ]


@query("meta_model_report", "L9 A26 A30 U1 S9 R18 R19 T10")
def meta_model_report(t: Tables) -> DataFrame:
    """Profiles of the fleet, the forest trained on them, stored and loaded, and its scores and importances."""
    profiles, _ = profile_fleet(t.spark, fleet_sources(t))
    folder = scratch(t.spark)
    model = load_model(t.spark, folder, save_model(train_meta_model(profiles.withColumn("dataset", F.col("title"))), folder))
    metrics = model.metrics.select(F.lit("metric").alias("part"), F.col("metric").alias("name"), F.format_string("%.4f ± %.4f", "mean", "std").alias("value"))
    cells = model.confusion.select(
        F.lit("confusion").alias("part"), F.concat_ws(" → ", "label", "prediction").alias("name"), F.col("n").cast("string").alias("value")
    )
    best = evaluation.top_importances(model.importances).select(
        F.lit("importance").alias("part"), F.col("feature").alias("name"), F.format_string("%.4f", "importance").alias("value")
    )
    advice = hybrid(decide(profiles), score(profiles, model)).select(
        F.lit("advice").alias("part"), F.col("dataset").alias("name"), F.concat_ws(" by ", "task_type_code", "source").alias("value")
    )
    return metrics.unionByName(cells).unionByName(best).unionByName(advice)


@query(
    "catalog_vectors",
    "L10 X6 X7 X8 M3 J7",
    "SELECT title, true AS is_active, 128::INTEGER AS length, n_rows, n_cols FROM (SELECT 'region' AS title, count(*) AS n_rows, 2::BIGINT AS n_cols FROM region "
    "UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'supplier', count(*), 4 FROM supplier)",
)
def catalog_vectors(t: Tables) -> DataFrame:
    """Profiles scaled, padded and merged into the catalog; a second load changes nothing."""
    from tableprobe.plans.catalog import feature_table, fit_feature_scale

    profiles = None
    for name in ("region", "nation", "supplier"):
        one = profile(getattr(t, name), name).table
        profiles = one if profiles is None else profiles.unionByName(one)
    profiles = profiles.withColumn("title", F.col("dataset"))
    entries = embed(profiles, fit_feature_scale(feature_table(profiles))).select(
        "title", F.lit(True).alias("is_active"), "vector", "vector_order", "n_rows", "n_cols"
    )
    merged = usable(load_catalog(load_catalog(entries.where("false"), entries), entries))
    return merged.select("title", "is_active", F.size("vector").alias("length"), "n_rows", "n_cols")
