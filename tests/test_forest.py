"""Regressions that are trained by scans of binned rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.operators import baseline, forest
from tableprobe.operators.baseline import train_baseline
from tableprobe.operators.evaluation import REGRESSION
from tableprobe.operators.sampling import plain_folds


def houses(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size, age, kind = float(rng.integers(20, 200)), float(rng.integers(0, 5)), "abc"[rng.integers(0, 3)]
        price = 3 * size - 10 * age + {"a": 0, "b": 80, "c": -40}[kind] + float(rng.normal(scale=5))
        rows.append((i, None if rng.random() < 0.1 else size, float("inf") if rng.random() < 0.05 else age, None if rng.random() < 0.1 else kind, price))
    return spark.createDataFrame(rows, "id long, size double, age double, kind string, price double")


@pytest.mark.parametrize("features, once", [(500, True), (0, False)])
def test_by_scans_like_in_memory(spark, monkeypatch, features, once):
    df = houses(spark).cache()
    kept = train_baseline(df, "price", REGRESSION, "id", fit_once=once)
    fits = []
    monkeypatch.setattr(baseline, "NORMAL_FEATURES", features)
    monkeypatch.setattr(baseline, "ROWS_IN_MEMORY", 0)
    monkeypatch.setattr(baseline, "RandomForestRegressor", lambda **_: fits.append(1))
    found = train_baseline(df, "price", REGRESSION, "id", fit_once=once)
    assert not fits  # the estimator whose rows do not stay in memory
    a, b = ({(r["model"], r["metric"]): r["mean"] for r in x.metrics.collect()} for x in (kept, found))
    for metric in ("mae", "rmse", "r2"):
        assert a["ridge", metric] == pytest.approx(b["ridge", metric], rel=1e-7)
        assert a["random_forest", metric] == pytest.approx(b["random_forest", metric], rel=0.1)
    shares = [{r["feature"]: r["importance"] for r in x.importances.collect()} for x in (kept, found)]
    assert shares[0].keys() == shares[1].keys() and sum(shares[1].values()) == pytest.approx(1)
    assert all(abs(shares[0][c] - shares[1][c]) < 0.05 for c in shares[0])
    assert (found.n_rows, found.n_features, found.predictions.count()) == (kept.n_rows, kept.n_features, 800)


def brute(x, y, w, codes, depth):
    """Mean of the last node of every row, by trying all splits."""
    out = np.full(len(y), np.average(y, weights=w) if w.sum() else 0.0)
    if not depth:
        return out
    best, mean = (1e-9, None), out[0]
    for c, (kind, bins) in enumerate(codes):
        for v in range(bins - (kind == "number")):
            right = x[c] == v if kind == "level" else x[c] > v
            if w[right].sum() and w[~right].sum():
                gain = sum(w[s].sum() * (np.average(y[s], weights=w[s]) - mean) ** 2 for s in (right, ~right))
                best = max(best, (gain, right), key=lambda b: b[0])
    if best[1] is not None:
        for s in (best[1], ~best[1]):
            out[s] = brute([a[s] for a in x], y[s], w[s], codes, depth - 1)
    return out


@pytest.mark.parametrize("cells", [1, 4096])
def test_trees_like_all_splits_tried(spark, monkeypatch, cells):
    monkeypatch.setattr(forest, "GROUP_CELLS", cells)
    rng = np.random.default_rng(2)
    n = 900  # no bin of a node is empty, so no two splits are equal
    x = [rng.integers(0, 5, n), rng.integers(0, 3, n), rng.integers(0, 6, n)]
    y = np.where(x[0] > 2, 5.0 * x[0], 2.0 * (x[1] == 1)) + 0.3 * x[2] + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([(i, i % 2, float(v), float(a), int(b), float(c)) for i, (v, a, b, c) in enumerate(zip(y, *x))], "row long, fold int, label double, a double, b int, c double")
    columns = forest.numeric_columns(df, ["a", "c"]) + [forest.Column("b", levels=3)]
    assert [c.bins for c in columns] == [5, 6, 4]
    layout = forest.laid_out(columns)
    rows = forest.with_cells(df.select("row", "fold", "label", F.col("a").alias("x0"), F.col("c").alias("x1"), F.col("b").alias("x2")), layout).repartition(3).cache()
    fills = [0] * len(columns)
    grown = forest.grow(rows, layout, {0: fills, 1: fills, None: fills}, trees=3, depth=3, seed=1)
    got = sorted((r["label"], r["prediction"]) for r in forest.predictions(rows, layout, grown).collect())
    weights = forest.bag_weights(np.arange(n), 3, 1).astype(float)
    binned = [x[0], x[2], x[1]]
    codes, want = [("number", 5), ("number", 6), ("level", 3)], np.zeros(n)
    for fold in (0, 1):
        for w in weights:
            want += np.where(np.arange(n) % 2 == fold, brute(binned, y, w * (np.arange(n) % 2 != fold), codes, 3), 0) / 3
    assert np.allclose(sorted(zip(y, want)), got, atol=1e-9)


def test_weights_are_poisson():
    w = forest.bag_weights(np.arange(200_000), 6, 42)
    assert w.shape == (6, 200_000) and np.abs(w.mean(axis=1) - 1).max() < 0.01 and np.abs(w.var(axis=1) - 1).max() < 0.02
    assert np.abs(np.corrcoef(w) - np.eye(6)).max() < 0.01


def test_ridge_by_scans_equals_the_closed_form(spark, monkeypatch):
    monkeypatch.setattr(baseline, "ROWS_IN_MEMORY", 0)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([3.0, -2.0, 0.5]) + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    rows = train_baseline(df, "y", REGRESSION, "id").predictions.where("model = 'ridge' and fold = 0").collect()
    fold = {r["id"]: r["fold"] for r in plain_folds(df, "id").collect()}
    inside = np.array([fold[i] != 0 for i in range(200)])
    z = (x - x[inside].mean(0)) / x[inside].std(0)
    w = np.linalg.solve(z[inside].T @ z[inside] + np.eye(3), z[inside].T @ (y[inside] - y[inside].mean()))
    assert sorted(r["prediction"] for r in rows) == pytest.approx(sorted(z[~inside] @ w + y[inside].mean()), abs=1e-8)


def test_edges_of_few_and_many_values(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("few"), F.sqrt("id").alias("many"), F.lit(None).cast("double").alias("none"))
    few, many, none = forest.numeric_columns(df, ["few", "many", "none"])
    assert few.edges == [0, 1, 2, 3, 4, 5] and len(many.edges) == 31 and none.edges == []
    counts = np.histogram(np.sqrt(np.arange(5000)), [-1, *many.edges, 99])[0]
    assert counts.min() > 140 and counts.max() < 170
