"""Models, vectors, sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.functions.vectors import FEATURE_ORDER, order_fingerprint
from tableprobe.operators import evaluation, neighbours, preparation
from tableprobe.operators.baseline import train_baseline
from tableprobe.operators.evaluation import BINARY, MULTICLASS, REGRESSION, roc_auc
from tableprobe.plans.catalog import usable
from tableprobe.plans.meta_model import load_model, save_model, score, train_meta_model
from tableprobe.sources import csv as csv_source
from tableprobe.sources import store


def flowers(spark, label="number"):
    rng = np.random.default_rng(42)
    rows = [(i, *[float(v) for v in rng.normal(loc=[c * 2, c, 3 - c, 1], scale=0.5)], c) for i, c in enumerate([0, 1, 2] * 50)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int")


def test_forest_on_three_classes(spark):
    found = train_baseline(flowers(spark), "label", MULTICLASS, "id")
    metrics = {(r["model"], r["metric"]): r["mean"] for r in found.metrics.collect()}
    assert metrics[("random_forest", "accuracy")] >= 0.9 and metrics[("logistic_regression", "f1_macro")] >= 0.9
    assert found.n_rows == 150 and found.n_features == 4
    assert found.predictions.count() == 300


def test_leakage_columns_are_left_out_and_gaps_filled(spark):
    n = F.col("id")
    df = spark.range(200).select(
        "id", F.when(n % 10 != 0, F.randn(1)).alias("num"), F.when(n % 14 != 0, F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (n % 3 + 1).cast("int"))).alias("cat"),
        (n % 2).cast("int").alias("leak"), F.current_timestamp().alias("at"), (n % 2).cast("int").alias("target"),
    )
    found = train_baseline(df, "target", BINARY, "id", leakage=["leak"])
    names = {r["feature"] for r in found.importances.collect()}
    assert names == {"num", "cat_x", "cat_y", "cat_z"} and found.excluded == ["leak"]
    assert {r["metric"] for r in found.metrics.collect()} == {"accuracy", "precision", "recall", "f1", "roc_auc"}


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = x @ np.array([3.0, -2.0, 0.5]) + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    found = train_baseline(df, "y", REGRESSION, "id")
    metrics = {(r["model"], r["metric"]): r["mean"] for r in found.metrics.collect()}
    assert metrics[("ridge", "r2")] > 0.99 and metrics[("random_forest", "r2")] >= 0.3
    rows = found.predictions.where("model = 'ridge' and fold = 0").collect()
    from tableprobe.operators.sampling import plain_folds

    fold = {r["id"]: r["fold"] for r in plain_folds(df, "id").collect()}
    inside = np.array([fold[i] != 0 for i in range(300)])
    mean, std = x[inside].mean(0), x[inside].std(0)
    z = (x - mean) / std
    w = np.linalg.solve(z[inside].T @ z[inside] + np.eye(3), z[inside].T @ (y[inside] - y[inside].mean()))
    expected = sorted(z[~inside] @ w + y[inside].mean())
    assert sorted(r["prediction"] for r in rows) == pytest.approx(expected, abs=1e-4)


def test_unknown_and_missing_tasks(spark):
    assert train_baseline(flowers(spark), "label", "CLUSTERING", "id").models == []
    with pytest.raises(NotImplementedError):
        train_baseline(flowers(spark), "label", "FORECASTING", "id")


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [("m", int(f), int(l), float(s)) for f, l, s in zip(rng.integers(0, 2, 400), rng.integers(0, 2, 400), rng.integers(0, 30, 400) / 30)]
    df = spark.createDataFrame(rows, "model string, fold int, label int, score double")
    for r in roc_auc(df, 1, ["model", "fold"]).collect():
        mine = [x for x in rows if x[1] == r["fold"]]
        pos, neg = [x[3] for x in mine if x[2] == 1], [x[3] for x in mine if x[2] == 0]
        brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
        assert r["value"] == pytest.approx(brute, abs=1e-12)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_neighbours_by_broadcast_and_by_blocks(spark, monkeypatch, metric):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(v)], "id long, vector array<double>")
    near = {(r["query_id"], r["rank"]): (r["catalog_id"], r["distance"]) for r in neighbours.nearest(df, df, metric=metric, k=3).collect()}
    monkeypatch.setattr(neighbours, "CATALOG_BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK_ROWS", 11)
    blocks = {(r["query_id"], r["rank"]): (r["catalog_id"], r["distance"]) for r in neighbours.nearest(df, df, metric=metric, k=3, broadcast_bytes=0).collect()}
    assert {k: x[0] for k, x in near.items()} == {k: x[0] for k, x in blocks.items()} and len(near) == 180
    for i in range(60):
        assert near[(i, 1)][0] == i and abs(near[(i, 1)][1]) < 1e-6
        assert near[(i, 1)][1] <= near[(i, 2)][1] <= near[(i, 3)][1]
    with pytest.raises(ValueError):
        neighbours.nearest(df, df, metric="hamming")


def test_feature_order_is_guarded(spark):
    assert len(FEATURE_ORDER) == 16 and len(set(FEATURE_ORDER)) == 16
    good = spark.range(1).select(order_fingerprint().alias("vector_order"))
    assert usable(good).count() == 1
    with pytest.raises(ValueError):
        usable(good.withColumn("vector_order", F.lit("old")))


def test_auc_over_many_score_ranges(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SCORES_PER_PIECE", 7)
    rng = np.random.default_rng(3)
    rows = [("m", int(f), int(l), float(s)) for f, l, s in zip(rng.integers(0, 2, 600), rng.integers(0, 2, 600), rng.integers(0, 90, 600) - 5.0)]
    df = spark.createDataFrame(rows, "model string, fold int, label int, score double")
    found = {r["fold"]: r["value"] for r in roc_auc(df, 1, ["model", "fold"]).collect()}
    for fold in (0, 1):
        pos, neg = ([x[3] for x in rows if x[1] == fold and x[2] == y] for y in (1, 0))
        assert found[fold] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]), abs=1e-12)
    assert [r["value"] for r in roc_auc(df.where("label = 1"), 1, ["model"]).collect()] == [None]
    assert roc_auc(df.where("false"), 1, ["model"]).count() == 0


def test_meta_model_learns_the_number_of_values(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        task, values = [(BINARY, 2), (MULTICLASS, int(rng.integers(3, 15))), (REGRESSION, int(rng.integers(200, 900)))][i % 3]
        rows.append((f"d{i}", task, int(rng.integers(100, 5000)), 10, values, float(rng.random())))
    df = spark.createDataFrame(rows, "dataset string, task_type_code string, n_rows long, n_cols long, target_n_unique long, outliers_pct double")
    for name in FEATURE_ORDER:
        if name not in df.columns and not name.startswith("__"):
            df = df.withColumn(name, F.lit(None).cast("double"))
    model = train_meta_model(df, folds=3)
    metrics = {r["metric"]: r["mean"] for r in model.metrics.collect()}
    assert metrics["f1_macro"] > 0.9 and model.n_rows == 90
    assert model.importances.orderBy(F.desc("importance")).first()["feature"] == "target_n_unique"
    assert sum(r["n"] for r in model.confusion.collect()) == 90
    scored = score(df, model)
    assert scored.join(df, "dataset").where("ml_class = task_type_code").count() >= 85
    assert scored.first()["ml_probabilities"].keys() == {BINARY, MULTICLASS, REGRESSION}

    folder = str(tmp_path)
    with pytest.raises(ValueError, match="no model"):
        load_model(spark, folder)
    assert [save_model(model, folder), save_model(model, folder)] == [1, 2]
    (tmp_path / "models" / "left-behind").mkdir()  # an interrupted save
    for version in (None, 1):
        again = load_model(spark, folder, version)
        assert score(df, again).orderBy("dataset").collect() == scored.orderBy("dataset").collect()
        assert (again.classes, again.n_rows, again.scale) == (model.classes, 90, model.scale)
        assert sorted(again.confusion.collect()) == sorted(model.confusion.collect())
    with pytest.raises(ValueError, match="version 3"):
        load_model(spark, folder, 3)
    old = spark.read.parquet(f"{folder}/versions").where("version = 2")
    old.withColumn("version", F.lit(4)).withColumn("vector_order", F.lit("old")).write.mode("append").parquet(f"{folder}/versions")
    with pytest.raises(ValueError, match="another feature order"):
        load_model(spark, folder)


def test_imputing_an_empty_column(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "a")], "id int, x double, c string")
    fills = preparation.fill_values(df, ["x"], ["c"])
    assert fills == {"x": 0.0, "c": "a"}
    assert preparation.impute(df, fills).where("x is null or c is null").count() == 0


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(preparation, "MAX_LEVELS", 3)
    df = spark.range(10).select("id", F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        preparation.Encoder([], ["c"]).fit_levels(df)


def test_csv_types_keep_dates_as_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a;b;c;d\n1;1.5;2024-01-01;true\n2;NA;2024-01-02;false\n")
    df = csv_source.read_csv(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean")]
    assert df.where("b is null").count() == 1


def test_records_as_list_or_lines(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[{"title": "a", "n_rows": 1}, {"title": "b", "n_rows": 2}]')
    assert store.read_records(spark, str(path)).count() == 2
    assert store.records_or_none(spark, str(tmp_path / "none.json")) is None
    store.write_records(spark.createDataFrame([(float("nan"), 1)], "x double, n int"), str(tmp_path / "out"))
    assert store.read_records(spark, str(tmp_path / "out"), "x double, n int").first()["x"] is None
