"""Fleets of tables, the chain from a profile to similar datasets, and neighbours by any key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.functions.vectors import FEATURE_ORDER
from tableprobe.operators import neighbours
from tableprobe.operators.neighbours import nearest
from tableprobe.plans.catalog import embed, feature_table, fit_feature_scale, load_catalog, similar_datasets, usable
from tableprobe.plans.fleet import Source, profile_fleet
from tableprobe.plans.report import category_charts


def broken():
    raise ValueError("no such table")


@pytest.fixture(scope="module")
def fleet(spark):
    def table(n, k):
        return lambda: spark.range(n).select(*[(F.col("id") * (i + 3) % (i + 5)).cast("double").alias(f"c{i}") for i in range(k)])

    unread = spark.range(3).select(F.expr("cast('x' as int)").alias("x"))
    sources = [Source("one", table(40, 2)), Source("one", table(60, 3)), Source("two", table(50, 4)), Source("bad", broken), Source("late", lambda: unread)]
    rows, errors = profile_fleet(spark, sources)
    return sources, rows.cache(), errors


def test_sources_of_one_title_and_broken_ones(fleet):
    _, rows, errors = fleet
    got = {(r.title, r.dataset): (r.n_rows, r.n_cols) for r in rows.collect()}
    assert got == {("one", "one"): (40, 2), ("one", "one #2"): (60, 3), ("two", "two"): (50, 4)}
    assert sorted(r.title for r in errors.collect()) == ["bad", "late"]


def test_known_signatures_are_not_profiled_again(spark, fleet, monkeypatch):
    sources, rows, _ = fleet
    monkeypatch.setattr("tableprobe.plans.fleet.profile", lambda *a: pytest.fail("profiled again"))
    again, errors = profile_fleet(spark, sources[:3], rows)
    assert again.count() == 3 and errors.isEmpty()


def test_profile_scale_vector_and_similar_by_title(fleet):
    _, rows, _ = fleet
    profiles = rows.withColumn("title", F.col("dataset"))
    scale = fit_feature_scale(feature_table(profiles))
    entries = embed(profiles, scale).select("title", F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("task_type_code"), "vector", "vector_order", "n_rows", "n_cols")
    catalog = usable(load_catalog(entries.where("false"), entries))
    names = [f"f{i}" for i in range(len(FEATURE_ORDER))]
    table = feature_table(profiles).orderBy("title").toPandas()
    x = table[names].to_numpy(float)
    spread = x.std(axis=0)
    want = np.where(spread > 0, (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1), 0.0)
    got = {r.title: r.vector for r in catalog.collect()}
    for title, values in zip(table["title"], want):
        assert len(got[title]) == 128 and np.allclose(got[title][: len(names)], values, atol=1e-9)
    found = similar_datasets(catalog, catalog, metric="euclidean", k=2, query_id="title", catalog_id="title").collect()
    for r in found:
        order = sorted((np.linalg.norm(np.array(got[r.query_id]) - np.array(v)), t) for t, v in got.items())
        assert r.catalog_id == order[r["rank"] - 1][1] and r.distance == pytest.approx(order[r["rank"] - 1][0])
    assert len(found) == 6


@pytest.mark.parametrize("group", [None, "g"])
@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_neighbours_by_title_in_blocks(spark, monkeypatch, group, limit):
    monkeypatch.setattr(neighbours, "CATALOG_BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK_ROWS", 15)
    rng = np.random.default_rng(1)
    rows = [(f"t{n:03d}", int(rng.integers(0, 3)), [float(v) for v in rng.integers(0, 5, 3)]) for n in range(90)] + [("none", 1, None), ("alone", 9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id string, g int, vector array<double>")
    found = nearest(df, df, metric="manhattan", k=3, group=group, skip_self=True, broadcast_bytes=limit).collect()
    want = {}
    for a, g, v in rows:
        near = sorted((sum(abs(p - q) for p, q in zip(v, w)), b) for b, h, w in rows if v and w and a != b and (group is None or g == h))
        want.update({(a, k + 1): (b, d) for k, (d, b) in enumerate(near[:3])})
    assert {(r.query_id, r["rank"]): (r.catalog_id, r.distance) for r in found} == want


def test_bars_are_per_dataset(spark):
    counts = spark.createDataFrame([("x", "c", "a", 3), ("x", "c", "b", 1), ("y", "c", "a", 5), ("y", "c", "z", 9)], "dataset string, column string, value string, n long")
    columns = spark.createDataFrame([("x", "c", 0, "categorical", 0.01), ("y", "c", 0, "categorical", 0.01)], "dataset string, column string, position int, kind string, cardinality_ratio double")
    bars, _ = category_charts(counts, columns, F.lit(1000), bars=1)
    got = sorted((r.dataset, r["rank"], r.value, r.n) for r in bars.collect())
    assert got == [("x", 1, "a", 3), ("x", 2, "other (1)", 1), ("y", 1, "z", 9), ("y", 2, "other (5)", 5)]
