"""Facts about small tables: numbers, categories, targets, samples."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.operators import categorical, distribution, normality, numeric, order_stats, relation, sampling, states, structure
from tableprobe.operators import target as target_ops


def frame(spark, name, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_iqr_marks_only_the_far_value(spark):
    row = numeric.outliers(frame(spark, "x", [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]), ["x"]).first()
    assert (row["iqr_outliers"], row["n_outliers"]) == (1, 1)


def test_z_score_marks_one_extreme(spark):
    values = [float(v) for v in np.random.default_rng(42).normal(size=200)] + [10.0]
    row = numeric.outliers(frame(spark, "x", values), ["x"], normal={"x"}).first()
    assert row["n_outliers"] == 1


def test_constant_has_no_outliers_and_low_variance(spark):
    df = frame(spark, "x", [7.0] * 10)
    row = numeric.outliers(df, ["x"], normal={"x"}).first()
    assert (row["iqr_outliers"], row["z_outliers"]) == (0, 0)
    m = numeric.moments(df, ["x"]).first()
    assert m["std"] == 0 and m["skewness"] is None and m["kurtosis"] is None


def test_moments_skip_missing_nan_and_infinite(spark):
    df = frame(spark, "x", [1.0, 2.0, 3.0, None, float("nan"), float("inf")])
    m = numeric.moments(df, ["x"]).first()
    assert (m["n_finite"], m["mean"], m["min"], m["max"]) == (3, 2.0, 1.0, 3.0)
    assert m["kurtosis"] is None  # needs four values


def test_empty_column_keeps_its_row(spark):
    df = frame(spark, "x", [None, float("nan")])
    assert numeric.moments(df, ["x"]).first()["n_finite"] == 0
    assert numeric.outliers(df, ["x"]).first()["outliers_pct"] == 0.0
    assert distribution.histograms(df, ["x"]).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_quantiles_are_exact_through_every_pass(spark, monkeypatch, held):
    monkeypatch.setattr(states, "HELD_CELLS", held)
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), rng.expovariate(0.001), 5.0, -3.0, 0.0, -0.0]) for _ in range(3000)] + [1e12, -1e9]
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = order_stats.quantiles(frame(spark, "x", values), ["x"], shares)["x"]
    for s in shares:
        assert found[s] == pytest.approx(float(np.quantile(values, s)), rel=1e-12)


def test_values_over_600_decades_and_neighbours_take_six_scans(spark, monkeypatch):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)]
    x = 1.0
    for _ in range(500):  # neighbouring doubles differ in the last bit
        values.append(x)
        x = math.nextafter(x, 2.0)
    scans = []
    monkeypatch.setattr(states, "scan", lambda *a, scan=states.scan: scans.append(1) or scan(*a))
    n, found = order_stats.values_at_ranks(frame(spark, "x", values), lambda n: range(0, n, 7), ["x"])
    assert n == {"x": 2500} and found["x"] == {r: v for r, v in enumerate(sorted(values)) if r % 7 == 0}
    assert len(scans) <= 6


def test_a_value_holding_a_third_of_the_rows(spark):
    values = [4.0] * 1000 + [float(i) for i in range(2000)]
    found = order_stats.quantiles(frame(spark, "x", values), ["x"], [0.2, 0.5])["x"]
    assert found[0.5] == np.quantile(values, 0.5) and found[0.2] == np.quantile(values, 0.2)


def test_rank_bins_count_smaller_values(spark):
    values = [random.Random(3).choice(range(40)) * 1.0 for _ in range(500)]
    values = [float(random.Random(i).randrange(40)) for i in range(500)]
    edges = order_stats.rank_bin_edges(frame(spark, "x", values), ["x"], 16)["x"]
    for v in set(values):
        assert sum(e < v for e in edges) == 16 * sum(u < v for u in values) // len(values)


def test_text_bins_are_ranks_of_the_sorted_values(spark):
    pick = random.Random(7)
    start = "the same seventy characters stand at the start of every one of them: x "
    texts = {
        "short": [f"w{pick.randrange(900):04d}" for _ in range(3000)],
        "common": [start + str(pick.randrange(1000)) for _ in range(3000)],
        "prefixes": [("ab" * pick.randrange(60)) + pick.choice(["", "a", "é", "漢", "😀"]) for _ in range(3000)],
        "one": ["only " * 40] * 3000,
        "gaps": [None if k % 3 else f"{pick.random()}" for k in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*texts.values())), ", ".join(f"{c} string" for c in texts))
    got = relation.text_bin_edges(df, list(texts), 16)
    for c, values in texts.items():
        known = sorted((v for v in values if v is not None), key=lambda v: v.encode())
        assert got[c] == [known[r] for r in order_stats.edge_ranks(len(known), 16)]
    assert relation.text_bin_edges(df.limit(0), ["short"], 16) == {"short": []}



def test_normality_from_moments(spark):
    df = spark.range(150_000).select((F.randn(7)).alias("a"), F.lit(3.0).alias("b"), F.rand(7).alias("c"), F.exp(F.randn(3)).alias("d"))
    rows = {r["column"]: r for r in normality.normality(df, ["a", "b", "c", "d"]).collect()}
    assert rows["a"]["is_normal"]
    assert rows["b"]["p_value"] is None and not rows["b"]["is_normal"]
    assert not rows["c"]["is_normal"] and not rows["d"]["is_normal"]
    again = {r["column"]: r["jb"] for r in normality.normality(df.repartition(11), ["a", "c"]).collect()}
    assert again["a"] == pytest.approx(rows["a"]["jb"], rel=1e-6)
    few = normality.normality(df.limit(3), ["a"]).first()
    assert few["p_value"] is None and not few["is_normal"]


def test_entropy_of_constant_and_uniform(spark):
    df = spark.createDataFrame([("a", c) for c in "wxyz" * 25], "same string, four string")
    rows = {r["column"]: r for r in categorical.entropies(categorical.value_counts(df, ["same", "four"])).collect()}
    assert (rows["same"]["entropy"], rows["same"]["normalized_entropy"]) == (0.0, 0.0)
    assert rows["four"]["entropy"] == pytest.approx(2.0) and rows["four"]["normalized_entropy"] == pytest.approx(1.0)


def test_fifteen_bars_and_the_rest(spark):
    df = frame(spark, "c", [f"cat{i:02d}" for i in range(1, 21) for _ in range(i)], "string")
    rows = categorical.folded_top(categorical.value_counts(df, ["c"]), 15).orderBy("rank").collect()
    assert len(rows) == 16 and rows[0]["value"] == "cat20" and rows[-1]["n"] == 15 and rows[-1]["value"] == "other (15)"


def test_duplicates_of_repeated_rows(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abc")] * 3, "a int, b string")
    row = structure.duplicates(df).first()
    assert row["duplicate_rows_pct"] == pytest.approx(6 / 9)


def test_duplicates_tell_where_the_null_is(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("ab", "c"), ("a", "bc"), (None, "a")], "x string, y string")
    assert structure.duplicates(df).first()["n_duplicates"] == 1
    assert structure.duplicates(df.where("false")).first()["duplicate_rows_pct"] == 0.0


def test_histogram_counts_every_value_once(spark):
    rows = distribution.histograms(frame(spark, "x", [0.0, 1.0, 2.0, None, 3.0]), ["x"], bins=3).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 1, 2] and rows[0]["bin_start"] == 0.0 and rows[-1]["bin_end"] == 3.0


def test_information_of_copy_and_of_chance(spark):
    rng = np.random.default_rng(42)
    rows = [(float(x), int(x), float(z), int(b)) for x, z, b in zip(rng.integers(0, 4, 500), rng.normal(size=500), rng.integers(0, 2, 500))]
    df = spark.createDataFrame(rows, "x double, y int, z double, b int").withColumn("id", F.monotonically_increasing_id())
    copy = dict(relation.mutual_information(df.select("x", "y"), "y").collect())
    assert copy["x"] == pytest.approx(math.log(4), abs=0.02)
    chance = dict(relation.mutual_information(df.select("z", "b"), "b").collect())
    assert chance["z"] < 0.1


def test_correlation_of_constant_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 0.1, 2.0), (2.0, 0.1, 4.0), (3.0, 0.1, None)], "a double, flat double, b double")
    rows = {(r["column_a"], r["column_b"]): r["r"] for r in relation.correlations(df, ["a", "flat", "b"]).collect()}
    assert rows[("a", "flat")] is None and rows[("flat", "b")] is None and rows[("a", "b")] == pytest.approx(1.0)


def test_twenty_related_columns_are_kept(spark):
    names = [f"c{i:02d}" for i in range(25)]
    long = spark.createDataFrame(
        [(a, b, 0.9 if i < 20 and j < 20 else 0.01, i, j) for i, a in enumerate(names) for j, b in enumerate(names)],
        "column_a string, column_b string, r double, position_a int, position_b int",
    )
    kept = relation.top_correlated(long, 20)
    assert [r["column_a"] for r in kept.collect()] == names[:20]
    assert relation.submatrix(long, kept).count() == 400


def test_target_kinds(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).cast("int").alias("few"), F.col("id").cast("double").alias("many"), F.concat(F.lit("k"), F.col("id")).alias("word"),
        F.lit(None).cast("int").alias("none"),
    )
    rows = {r["target"]: r for r in target_ops.target_stats(df, ["few", "many", "word", "none"]).collect()}
    assert rows["few"]["target_kind"] == "categorical" and rows["few"]["target_n_unique"] == 3 and rows["few"]["all_number_labels"]
    assert rows["many"]["target_kind"] == "regression" and rows["many"]["target_skewness"] == pytest.approx(0, abs=1e-9)
    assert rows["word"]["target_kind"] == "categorical" and rows["word"]["min_class_size"] == 1
    assert rows["none"]["target_kind"] is None


def test_sample_keeps_class_shares_and_size(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 10 < 3).cast("int").alias("y"))
    part, record = sampling.sampled(df, "id", "y", threshold=50_000, size=50_000)
    info = record.first()
    assert info["sampled"] and info["original_size"] == 60_000 and info["sample_size"] == 50_000
    assert part.where("y = 1").count() == 15_000
    assert sampling.random_sample(df, "id", 1234).count() == 1234
    assert sampling.random_sample(df, "id", 70_000).count() == 60_000
    whole, record = sampling.sampled(df, "id", threshold=100_000)
    assert not record.first()["sampled"] and whole.count() == 60_000


def test_class_ranks_do_not_depend_on_buckets(spark, monkeypatch):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    one = {(r["id"], r["class_rank"]) for r in sampling.rank_in_class(df, "y", "id").collect()}
    monkeypatch.setattr(sampling, "ROWS_PER_BUCKET", 50)
    assert {(r["id"], r["class_rank"]) for r in sampling.rank_in_class(df, "y", "id").collect()} == one


@pytest.mark.parametrize("classes", [0, 100])
def test_stratified_sample_takes_the_first_of_each_class_without_moving_whole_rows(spark, monkeypatch, classes):
    monkeypatch.setattr(sampling, "BROADCAST_CLASSES", classes)
    rows = [(n, None if n % 50 == 0 else "a" if n % 3 else "b" if n % 9 else "c", "w" * 50) for n in range(3000)] + [(9999, "rare", "w")]
    df = spark.createDataFrame(rows, "id long, y string, wide string")
    part = sampling.stratified_sample(df, "y", "id", 300)
    ranked = sampling.rank_in_class(df, "y", "id").where(F.col("class_rank") <= F.rint(F.col("class_size") * 300 / len(rows)))
    assert part.columns == df.columns
    assert sorted(r["id"] for r in part.collect()) == sorted(r["id"] for r in ranked.collect())
    assert part.where("y IS NULL OR y = 'rare'").count() == 0
    if classes:
        assert "Exchange hashpartitioning" not in part._jdf.queryExecution().executedPlan().toString()
    assert sampling.stratified_sample(df.where("false"), "y", "id", 300).count() == 0


@pytest.mark.parametrize("size", [6, 7, 20])
def test_stratified_sample_of_a_small_table_is_the_whole_table(spark, size):
    df = spark.createDataFrame([(n, "a" if n % 3 else "b", "w") for n in range(6)] + [(6, None, "w")], "id long, y string, wide string")
    part = sampling.stratified_sample(df.where("y IS NOT NULL"), "y", "id", size)
    assert sorted(tuple(r) for r in part.collect()) == sorted(tuple(r) for r in df.where("y IS NOT NULL").collect())


def test_long_texts_are_counted_by_key_and_shown_in_full(spark):
    long_a, long_b = "a" * 500, "a" * 499 + "b"
    df = spark.createDataFrame([(v,) for v in [long_a] * 3 + [long_b] * 2 + ["short", None]], "t string")
    counts = categorical.distinct_counts(df, ["t"])
    assert max(len(r["value"]) for r in counts.collect()) < 100
    assert categorical.entropies(counts).first()["n_distinct"] == 3
    top = categorical.with_long_texts(categorical.top_with_rest(counts, 2), df, ["t"]).orderBy("rank").collect()
    assert [(r["value"], r["n"], r["other_count"]) for r in top] == [(long_a, 3, 1), (long_b, 2, 1)]


def test_ties_follow_one_rule_for_all_lengths(spark):
    texts = [c * n for n in (3, 64, 65, 500) for c in "abc"] + ["\u0001md5:x"]
    df = spark.createDataFrame([(v,) for v in texts], "t string")
    top = categorical.with_long_texts(categorical.top_with_rest(categorical.distinct_counts(df, ["t"]), 13), df, ["t"]).orderBy("rank")
    assert [r["value"] for r in top.collect()] == sorted(texts, key=lambda v: hashlib.md5(v.encode()).hexdigest())


def test_information_of_one_row_is_unknown(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, y string")
    assert [r["mi"] for r in relation.mutual_information(df, "y").collect()] == [None]
    assert [r["mi"] for r in relation.mutual_information(df.limit(0), "y").collect()] == [None]


@pytest.mark.parametrize("width", [2, 14, 15, 70])
def test_correlations_alike_at_any_width(spark, monkeypatch, width):
    """Gaps, constants, constants within the shared rows, far means, and an infinite value that takes no part."""
    monkeypatch.setattr(states, "FAN_IN", 2)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width)) + rng.normal(size=400)[:, None]
    x[:, 0] += 1e9
    x[:, width // 2] = 0.1
    x[rng.random((400, width)) < 0.2] = np.nan
    x[:, -1] = np.where(np.isnan(x[:, -1]), np.nan, rng.integers(0, 2, 400))
    x[~np.isnan(x[:, -1]), 1] = 7.0
    names = [f"c{i}" for i in range(width)]
    seen = x.copy()
    seen[3, 0] = np.inf
    x[3, 0] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in seen], ", ".join(f"{n} double" for n in names))
    found = {(r.column_a, r.column_b): r.r for r in relation.correlations(df.repartition(7), names).collect()}
    assert len(found) == width * (width - 1) // 2
    for i in range(width):
        for j in range(i + 1, width):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = None if len(a) < 2 or a.min() == a.max() or b.min() == b.max() else np.corrcoef(a, b)[0, 1]
            got = found[names[i], names[j]]
            assert (got is None) == (want is None) and (want is None or got == pytest.approx(want, abs=1e-6))
