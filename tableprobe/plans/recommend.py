"""Which kind of learning task a table is ready for: a decision table, then a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.operators.evaluation import BINARY, MULTICLASS, REGRESSION

CLUSTERING = "CLUSTERING"
NOT_READY = "NOT_READY"

# Confidence from which the rules decide alone, limits of the decision table.
RULES_DECIDE_FROM = 0.7
BRIDGE_MIN, BRIDGE_MAX = 3, 20
MANY_COLUMNS = 10
FEW_NUMBERS, SOME_NUMBERS = 10, 20
SYMMETRIC_BELOW = 1.0
IMBALANCED_ABOVE = 10.0
SMALL_CLASS = 50
ID_SHARE = 0.5

# Flags repeated as warnings in a recommendation.
WARNING_TEXTS = {
    "TARGET_MISSING": "warning: target column, NULL values present, such rows left out of the fit",
    "LEAKAGE_SUSPICION": "warning: feature column, near copy of the target possible",
    "SMALL_DATASET": "warning: table, row count low, scores unsteady",
}

RULE_TEXTS = {
    "NO_TARGET_HIGH_DIM": "target: none; columns: over 10",
    "DIMENSIONALITY_REDUCTION": "step before clustering: fewer dimensions",
    "NO_TARGET_LOW_DIM": "target: none; columns: 10 or fewer",
    "NUMERIC_BINARY_TARGET": "target: number; distinct values: 1 or 2",
    "AMBIGUOUS_NUMERIC_TARGET": "target: number; distinct values: between class and quantity, model asked",
    "NUMERIC_TARGET_SYMMETRIC_FEW_VALUES": "target: number; distinct values: few; skewness: small",
    "NUMERIC_TARGET_MANY_VALUES": "target: number; distinct values: many",
    "ONLY_ONE_CLASS": "target: one class in all rows",
    "BINARY_IMBALANCED": "target: two classes; ratio: over 10",
    "BINARY_BALANCED": "target: two classes; ratio: up to 10",
    "MULTICLASS": "target: 3 to 20 classes",
    "TARGET_LOOKS_LIKE_ID": "target: distinct values in over half of the rows",
    "HIGH_CARDINALITY_MULTICLASS": "target: over 20 classes, model asked",
    "UNKNOWN_TARGET_KIND": "target: neither number nor category",
}

TASK_NAMES = {
    BINARY: "binary classification",
    MULTICLASS: "multiclass classification",
    REGRESSION: "regression",
    CLUSTERING: "clustering",
    NOT_READY: "not ready for learning",
}


def _decision(task: str, confidence: float, asks_model: bool, *codes: str) -> Column:
    return F.struct(
        F.lit(task).alias("task_type_code"),
        F.lit(confidence).alias("confidence"),
        F.lit(asks_model).alias("requires_ml"),
        F.array(*[F.lit(c) for c in codes]).alias("rule_codes"),
    )


def number_labels_bridge() -> Column:
    """Few classes whose labels are all numbers are judged like a numeric target."""
    few = F.col("target_n_unique").between(BRIDGE_MIN, BRIDGE_MAX)
    test = (F.col("target_kind") == "categorical") & few & F.col("all_number_labels")
    return F.coalesce(test, F.lit(False))


def decision() -> Column:
    """The decision of the rules for a row with the target facts of one profile."""
    values = F.coalesce(F.col("target_n_unique"), F.lit(0))
    no_target = F.col("target_column").isNull() | F.col("target_kind").isNull()
    numeric = (F.col("target_kind") == "regression") | number_labels_bridge()
    classes = F.col("target_kind") == "categorical"
    symmetric = F.coalesce(F.abs("target_skewness") < SYMMETRIC_BELOW, F.lit(False))
    unbalanced = F.coalesce(F.col("target_imbalance_ratio"), F.lit(0.0)) > IMBALANCED_ABOVE
    small_class = F.coalesce(F.col("min_class_size") < SMALL_CLASS, F.lit(False))
    like_id = values / F.greatest(F.coalesce(F.col("n_rows"), F.lit(0)), F.lit(1)) > ID_SHARE
    table = [
        (no_target & (F.col("n_cols") > MANY_COLUMNS),
         _decision(CLUSTERING, 0.8, False, "NO_TARGET_HIGH_DIM", "DIMENSIONALITY_REDUCTION")),
        (no_target, _decision(CLUSTERING, 0.9, False, "NO_TARGET_LOW_DIM")),
        (numeric & (values <= 2), _decision(BINARY, 0.95, False, "NUMERIC_BINARY_TARGET")),
        (numeric & (values <= FEW_NUMBERS), _decision(MULTICLASS, 0.5, True, "AMBIGUOUS_NUMERIC_TARGET")),
        (numeric & (values <= SOME_NUMBERS) & symmetric,
         _decision(MULTICLASS, 0.7, False, "NUMERIC_TARGET_SYMMETRIC_FEW_VALUES")),
        (numeric & (values <= SOME_NUMBERS), _decision(REGRESSION, 0.5, True, "AMBIGUOUS_NUMERIC_TARGET")),
        (numeric, _decision(REGRESSION, 0.95, False, "NUMERIC_TARGET_MANY_VALUES")),
        (classes & (values < 2), _decision(NOT_READY, 0.99, False, "ONLY_ONE_CLASS")),
        (classes & (values == 2) & unbalanced, _decision(BINARY, 0.9, False, "BINARY_IMBALANCED")),
        (classes & (values == 2), _decision(BINARY, 0.95, False, "BINARY_BALANCED")),
        (classes & (values <= 20) & small_class, _decision(MULTICLASS, 0.85, False, "MULTICLASS")),
        (classes & (values <= 20), _decision(MULTICLASS, 0.95, False, "MULTICLASS")),
        (classes & like_id, _decision(NOT_READY, 0.8, False, "TARGET_LOOKS_LIKE_ID")),
        (classes, _decision(MULTICLASS, 0.6, True, "HIGH_CARDINALITY_MULTICLASS")),
    ]
    chain = F.when(F.lit(False), table[0][1])
    for condition, outcome in table:
        chain = chain.when(condition, outcome)
    return chain.otherwise(_decision(NOT_READY, 0.5, False, "UNKNOWN_TARGET_KIND"))


def decide(profiles: DataFrame) -> DataFrame:
    """Profile rows plus task_type_code, confidence, requires_ml, rule_codes."""
    facts = profiles.drop("task_type_code", "confidence", "requires_ml", "rule_codes")
    return facts.withColumn("__d", decision()).select(*facts.columns, "__d.*")


def with_warnings(decided: DataFrame, flags: DataFrame) -> DataFrame:
    """Append the codes of critical flags; task and confidence stay as they are."""
    fired = (
        flags.where(F.col("rule_code").isin(list(WARNING_TEXTS)))
        .groupBy("dataset")
        .agg(F.sort_array(F.collect_set("rule_code")).alias("__fired"))
    )
    joined = decided.join(fired, "dataset", "left")
    codes = F.concat("rule_codes", F.coalesce("__fired", F.array().cast("array<string>")))
    return joined.withColumn("rule_codes", codes).drop("__fired")


def hybrid(decided: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Rules where they are sure, otherwise the model's class and probability.

    ``scored`` holds ``(dataset, ml_class, ml_confidence, ml_probabilities)``; without a
    model the rules stand.
    """
    if scored is None:
        out = decided.withColumn("source", F.lit("rules")).withColumn(
            "ml_probabilities", F.lit(None).cast("map<string,double>")
        )
        return out.withColumn("explanation", explanation(False, model_missing=True))
    joined = decided.join(scored, "dataset", "left")
    by_rules = (F.col("confidence") >= RULES_DECIDE_FROM) & ~F.col("requires_ml") | F.col("ml_class").isNull()
    out = joined.select(
        *[c for c in decided.columns if c not in ("task_type_code", "confidence")],
        F.when(by_rules, F.col("task_type_code")).otherwise(F.col("ml_class")).alias("task_type_code"),
        F.when(by_rules, F.col("confidence")).otherwise(F.col("ml_confidence")).alias("confidence"),
        F.when(by_rules, "rules").when(F.col("confidence") > 0, "hybrid").otherwise("ml").alias("source"),
        F.when(~by_rules, F.col("ml_probabilities")).alias("ml_probabilities"),
    )
    return out.withColumn("explanation", explanation(True))


def explanation(with_model: bool, model_missing: bool = False) -> Column:
    """Headline, one bullet per rule, and a sentence on the model where it decided."""
    names = F.create_map(*[F.lit(x) for kv in TASK_NAMES.items() for x in kv])
    texts = F.create_map(*[F.lit(x) for kv in {**RULE_TEXTS, **WARNING_TEXTS}.items() for x in kv])
    headline = F.concat(F.lit("task: "), names[F.col("task_type_code")])
    bullets = F.transform("rule_codes", lambda c: F.concat(F.lit("- "), F.coalesce(texts[c], c)))
    parts = [headline, F.when(F.size("rule_codes") > 0, F.lit("grounds:")), F.array_join(bullets, "\n")]
    if with_model:
        model = F.format_string("model: %.0f%% for this task", 100 * F.col("confidence"))
        parts.append(F.when(F.col("source") != "rules", model))
    if model_missing:
        parts.append(F.lit("model: no trained model, rules alone"))
    return F.concat_ws("\n", *parts)


def applied_rules() -> Column:
    """``array<struct<code, description>>`` from the rule codes."""
    texts = F.create_map(*[F.lit(x) for kv in {**RULE_TEXTS, **WARNING_TEXTS}.items() for x in kv])
    return F.transform("rule_codes", lambda c: F.struct(c.alias("code"), texts[c].alias("description")))
