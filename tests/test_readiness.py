"""The rules fire when they should, and the decision table has every branch."""

import pytest
from pyspark.sql import functions as F

from tableprobe.functions import dates
from tableprobe.plans.fleet import analyse
from tableprobe.plans.profile import profile
from tableprobe.plans.quality import quality_flags
from tableprobe.plans.recommend import decide, hybrid, with_warnings
from tableprobe.plans.rules import default_rules, seed_rules
from tableprobe.queries.readiness import COLUMN_FIELDS, TABLE_FIELDS, _with_fields

FACTS = (
    "dataset string, n_rows long, n_cols long, target_column string, target_kind string, target_n_unique long, "
    "target_imbalance_ratio double, target_skewness double, min_class_size long, all_number_labels boolean"
)


def decided(spark, **facts):
    base = dict(dataset="d", n_rows=1000, n_cols=10, target_column="y", target_kind=None, target_n_unique=None,
                target_imbalance_ratio=None, target_skewness=None, min_class_size=None, all_number_labels=False)
    row = {**base, **facts}
    return decide(spark.createDataFrame([tuple(row.values())], FACTS)).first()


@pytest.mark.parametrize(
    "facts,task,confidence,code,asks",
    [
        (dict(target_column=None, n_cols=50), "CLUSTERING", 0.8, "NO_TARGET_HIGH_DIM", False),
        (dict(target_column=None), "CLUSTERING", 0.9, "NO_TARGET_LOW_DIM", False),
        (dict(target_kind="regression", target_n_unique=2), "BINARY_CLASSIFICATION", 0.95, "NUMERIC_BINARY_TARGET", False),
        (dict(target_kind="regression", target_n_unique=5), "MULTICLASS_CLASSIFICATION", 0.5, "AMBIGUOUS_NUMERIC_TARGET", True),
        (dict(target_kind="regression", target_n_unique=15, target_skewness=0.2), "MULTICLASS_CLASSIFICATION", 0.7, "NUMERIC_TARGET_SYMMETRIC_FEW_VALUES", False),
        (dict(target_kind="regression", target_n_unique=15, target_skewness=-2.0), "REGRESSION", 0.5, "AMBIGUOUS_NUMERIC_TARGET", True),
        (dict(target_kind="regression", target_n_unique=15), "REGRESSION", 0.5, "AMBIGUOUS_NUMERIC_TARGET", True),
        (dict(target_kind="regression", target_n_unique=500), "REGRESSION", 0.95, "NUMERIC_TARGET_MANY_VALUES", False),
        (dict(target_kind="categorical", target_n_unique=1), "NOT_READY", 0.99, "ONLY_ONE_CLASS", False),
        (dict(target_kind="categorical", target_n_unique=2, target_imbalance_ratio=20.0), "BINARY_CLASSIFICATION", 0.9, "BINARY_IMBALANCED", False),
        (dict(target_kind="categorical", target_n_unique=2, target_imbalance_ratio=2.0), "BINARY_CLASSIFICATION", 0.95, "BINARY_BALANCED", False),
        (dict(target_kind="categorical", target_n_unique=5, min_class_size=10), "MULTICLASS_CLASSIFICATION", 0.85, "MULTICLASS", False),
        (dict(target_kind="categorical", target_n_unique=5, min_class_size=100), "MULTICLASS_CLASSIFICATION", 0.95, "MULTICLASS", False),
        (dict(target_kind="categorical", target_n_unique=800), "NOT_READY", 0.8, "TARGET_LOOKS_LIKE_ID", False),
        (dict(target_kind="categorical", target_n_unique=50), "MULTICLASS_CLASSIFICATION", 0.6, "HIGH_CARDINALITY_MULTICLASS", True),
        (dict(target_kind="categorical", target_n_unique=3, min_class_size=100, all_number_labels=True), "MULTICLASS_CLASSIFICATION", 0.5, "AMBIGUOUS_NUMERIC_TARGET", True),
        (dict(target_kind="categorical", target_n_unique=15, all_number_labels=True), "REGRESSION", 0.5, "AMBIGUOUS_NUMERIC_TARGET", True),
        (dict(target_kind="odd", target_n_unique=5), "NOT_READY", 0.5, "UNKNOWN_TARGET_KIND", False),
    ],
)
def test_decision_table(spark, facts, task, confidence, code, asks):
    row = decided(spark, **facts)
    assert (row["task_type_code"], row["confidence"], row["rule_codes"][0], row["requires_ml"]) == (task, confidence, code, asks)


def test_model_decides_only_where_rules_ask(spark):
    rows = [("sure", 1000, 5, "y", "regression", 900, None, 0.0, None, None), ("open", 1000, 5, "y", "regression", 5, None, 0.0, None, None)]
    both = decide(spark.createDataFrame(rows, FACTS))
    scored = spark.createDataFrame(
        [(d, "REGRESSION", 0.8, {"REGRESSION": 0.8}) for d in ("sure", "open")],
        "dataset string, ml_class string, ml_confidence double, ml_probabilities map<string,double>",
    )
    out = {r["dataset"]: r for r in hybrid(both, scored).collect()}
    assert (out["sure"]["source"], out["sure"]["confidence"], out["sure"]["ml_probabilities"]) == ("rules", 0.95, None)
    assert (out["open"]["source"], out["open"]["task_type_code"], out["open"]["confidence"]) == ("hybrid", "REGRESSION", 0.8)
    alone = {r["dataset"]: r for r in hybrid(both).collect()}
    assert alone["open"]["source"] == "rules" and "no trained model" in alone["open"]["explanation"]


def test_warnings_do_not_change_the_task(spark):
    row = decide(spark.createDataFrame([("d", 50, 5, "y", "categorical", 2, 1.0, None, 25, False)], FACTS))
    flags = spark.createDataFrame([("d", "SMALL_DATASET"), ("d", "OUTLIERS")], "dataset string, rule_code string")
    out = with_warnings(row, flags).first()
    assert out["rule_codes"] == ["BINARY_BALANCED", "SMALL_DATASET"] and out["confidence"] == 0.95


def column_flags(spark, rules=None, **measured):
    row = spark.createDataFrame([("d", "c")], "dataset string, column string")
    for k, v in measured.items():
        row = row.withColumn(k, F.lit(v))
    if "is_target" not in measured:
        row = row.withColumn("is_target", F.lit(False))
    table = spark.createDataFrame([("d", 10**6, 10**6, 50)], "dataset string, n_rows long, original_rows long, n_cols long")
    rules = default_rules(spark) if rules is None else rules
    return [r["rule_code"] for r in quality_flags(_with_fields(table, TABLE_FIELDS), _with_fields(row, COLUMN_FIELDS), rules).collect()]


@pytest.mark.parametrize(
    "measured,codes",
    [
        (dict(missing_pct=0.4), ["HIGH_MISSING"]),
        (dict(missing_pct=0.3), []),
        (dict(missing_pct=0.5, is_target=True), ["TARGET_MISSING"]),
        (dict(missing_pct=0.01, is_target=True), []),
        (dict(target_abs_r=0.99), ["LEAKAGE_SUSPICION"]),
        (dict(target_abs_r=0.99, target_mi=2.0), ["LEAKAGE_SUSPICION"]),
        (dict(target_mi=0.95), ["LEAKAGE_SUSPICION"]),
        (dict(target_abs_r=0.5, target_mi=0.2), []),
        (dict(mean=5.0, std=0.0), ["LOW_VARIANCE"]),
        (dict(mean=0.0, std=0.0), ["LOW_VARIANCE"]),
        (dict(mean=0.0, std=1.0), []),
        (dict(mean=1000.0, std=1.0), ["LOW_VARIANCE"]),
        (dict(normalized_entropy=0.05), ["LOW_VARIANCE"]),
        (dict(cardinality_ratio=0.9), ["HIGH_CARDINALITY"]),
        (dict(outliers_pct=0.1), ["OUTLIERS"]),
        (dict(outliers_pct=0.1, is_target=True), []),
        (dict(date_share=0.9), ["DATE_NOT_PARSED"]),
        (dict(date_share=0.89), []),
    ],
)
def test_column_rules(spark, measured, codes):
    assert column_flags(spark, **measured) == codes


def test_thresholds_and_activity_come_from_the_table(spark):
    rules = default_rules(spark)
    strict = rules.withColumn("thresholds", F.when(F.col("rule_code") == "HIGH_MISSING", F.create_map(F.lit("max_col_missing_pct"), F.lit(0.05))).otherwise(F.col("thresholds")))
    assert column_flags(spark, strict, missing_pct=0.1) == ["HIGH_MISSING"]
    off = rules.withColumn("is_active", F.col("rule_code") != "HIGH_MISSING")
    assert column_flags(spark, off, missing_pct=0.9) == []


def test_seeding_twice_changes_nothing(spark):
    changed = default_rules(spark).withColumn("severity", F.lit("info"))
    again = seed_rules(changed)
    assert again.count() == 12 and again.select("severity").distinct().collect() == [("info",)]


def dirty(spark):
    """A unique id, a constant, outliers, half missing, a leak, text dates, 8 % ones, repeated rows."""
    n = F.col("id")
    base = spark.range(200).select(
        F.concat(F.lit("id-"), n).alias("feat_id"), F.lit(1.0).alias("feat_constant"),
        F.when(n % 10 == 0, 500.0 + n).otherwise(n % 7).alias("feat_outliers"), F.when(n % 2 == 0, n * 1.0).alias("feat_missing"),
        ((n % 12 == 0).cast("double") + (n % 3) * 0.001).alias("feat_leak"), F.date_format(F.date_add(F.lit("2024-01-01"), n.cast("int")), "yyyy-MM-dd").alias("feat_date"),
        (n % 12 == 0).cast("int").alias("target"),
    )
    return base.unionByName(base.where(F.col("feat_outliers") < 2).limit(30))


def test_dirty_table_raises_many_flags(spark):
    found = profile(dirty(spark), "dirty", "target")
    codes = {r["rule_code"] for r in quality_flags(found.table, found.columns, default_rules(spark)).collect()}
    assert {"LEAKAGE_SUSPICION", "HIGH_MISSING", "DUPLICATES", "IMBALANCE_BINARY", "LOW_VARIANCE", "HIGH_CARDINALITY", "OUTLIERS", "DATE_NOT_PARSED"} <= codes


def test_clean_table_raises_next_to_nothing(spark):
    df = spark.range(200).select(*[(F.randn(i) + 5).alias(f"x{i}") for i in range(4)], F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    found = profile(df, "clean", "kind")
    assert quality_flags(found.table, found.columns, default_rules(spark)).count() <= 1


def test_profile_of_table_without_rows_or_target(spark):
    df = spark.createDataFrame([], "a int, b string")
    row = profile(df, "empty").table.first()
    assert (row["n_rows"], row["duplicate_rows_pct"], row["total_missing_pct"], row["target_kind"]) == (0, 0.0, 0.0, None)
    with pytest.raises(ValueError):
        profile(df, "empty", "nope")


def test_target_with_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "x int, y int")
    found = profile(df, "gaps", "y")
    flags = quality_flags(found.table, found.columns, default_rules(spark))
    assert "TARGET_MISSING" in {r["rule_code"] for r in flags.collect()}


def test_run_notes_a_missing_scale(spark):
    run = analyse(spark.range(60).selectExpr("id a", "id * 2 b", "id % 2 target"), "d", default_rules(spark), "target")
    assert [r["step"] for r in run.errors.collect()] == ["vector"]
    assert run.result.first()["task_type_code"] == "BINARY_CLASSIFICATION"


DATES = [
    ("2024-01-31", "2024-01-31 00:00:00"), ("2024/1/5", "2024-01-05 00:00:00"), ("20240131", "2024-01-31 00:00:00"), ("20240131T0930", "2024-01-31 09:30:00"),
    ("2024-01-31T10:20:30.123456Z", "2024-01-31 10:20:30"), ("2024-01-31 10:20+02:00", "2024-01-31 08:20:00"), ("2024-01-31 10:20:30-0530", "2024-01-31 15:50:30"),
    ("31.01.2024", "2024-01-31 00:00:00"), ("1/31/24 3:05 PM", "2024-01-31 15:05:00"), ("01/31/2024 12:10 am", "2024-01-31 00:10:00"), ("31 Jan 2024", "2024-01-31 00:00:00"),
    ("January 31, 2024", "2024-01-31 00:00:00"), ("Wed, 31 Jan 2024 10:00:00 GMT", "2024-01-31 10:00:00"), ("31-Jan-99", "1999-01-31 00:00:00"), ("3rd March 2020", "2020-03-03 00:00:00"),
    (" 29.02.2024 ", "2024-02-29 00:00:00"), ("29.02.2023", None), ("2024-13-01", None), ("31/31/2024", None), ("soon", None), ("may be", None), ("12.5", None), ("", None),
    ("2024-01-31 25:00", None), ("99999999", None), ("1-2-3-4", None), ("x" * 100_000, None), ("2024-01-31 " + "1" * 90, None), (None, None),
]


def test_date_spellings(spark):
    df = spark.createDataFrame([(t,) for t, _ in DATES], "d string")
    got = df.select("d", dates.is_date(F.col("d")).alias("is"), F.date_format(dates.parsed_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    assert [(r["d"], r["is"], r["at"]) for r in got] == [(t, at is not None, at) for t, at in DATES]
    share = df.agg(dates.date_share(F.col("d")).alias("s")).first()["s"]
    assert share == sum(at is not None for _, at in DATES) / (len(DATES) - 1)


@pytest.mark.parametrize("values,first", [(["01/02/2024", "13/02/2024"], True), (["01/02/2024", "02/13/2024"], False), (["01/02/2024"], False), (["13/1/2024", "1/13/2024"], False)])
def test_order_of_day_and_month_from_the_column(spark, values, first):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert dates.day_first(df, "d") == first
    got = df.select(dates.parsed_date(F.col("d"), first).cast("date").cast("string").alias("d")).first()["d"]
    if values[0] == "01/02/2024":
        assert got == ("2024-02-01" if first else "2024-01-02")
