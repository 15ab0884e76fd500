"""From a raw table to a modelling table: pruning, imputing, scaling, encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import column_groups, finite, is_numeric, nan_to_null, ref
from tableprobe.operators.categorical import distinct_counts, entropies, modes, value_counts, with_cardinality
from tableprobe.operators.order_stats import quantiles

# Fixed value: categories at or above this share of distinct values are left out.
MAX_ONE_HOT_RATIO = 0.1
MAX_LEVELS = 10_000


def cardinality(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Distinct values over rows for every named column."""
    rows = with_cardinality(entropies(distinct_counts(df, columns)), df.count()).collect()
    found = {r["column"]: r["cardinality_ratio"] for r in rows}
    return {c: found.get(c, 0.0) for c in columns}


def modelling_columns(
    df: DataFrame, target: str, leakage: list[str], ratios: dict[str, float], key: str | None = None
) -> dict[str, list[str]]:
    """Numeric and categorical features left after target, leaks, times and near-ids are out."""
    groups = column_groups(df, target)
    out = {target, *leakage, key}
    return {
        "numeric": [c for c in groups["numeric"] if c not in out],
        "categorical": [
            c for c in groups["categorical"] if c not in out and ratios.get(c, 0.0) < MAX_ONE_HOT_RATIO
        ],
    }


def fill_values(df: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, float | str]:
    """Exact median per number (0.0 if none), most frequent value per category (MISSING if none)."""
    fills: dict[str, float | str] = {}
    for c, q in quantiles(df, numeric, [0.5]).items():
        fills[c] = 0.0 if q[0.5] is None else q[0.5]
    found = {r["column"]: r["mode"] for r in modes(value_counts(df, categorical)).collect()} if categorical else {}
    for c in categorical:
        fills[c] = found.get(c, "MISSING")
    return fills


def impute(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c = field.name
        if c not in fills:
            out.append(ref(c))
        elif is_numeric(field.dataType):
            out.append(F.coalesce(finite(ref(c)), F.lit(float(fills[c]))).alias(c))
        else:
            out.append(F.coalesce(ref(c).cast("string"), F.lit(str(fills[c]))).alias(c))
    return df.select(*out)


@dataclass
class Scale:
    """Mean and population standard deviation per column."""

    mean: dict[str, float]
    std: dict[str, float]


def fit_scale(df: DataFrame, columns: list[str]) -> Scale:
    if not columns:
        return Scale({}, {})
    row = df.agg(
        *[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(ref(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return Scale(
        {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
        {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)},
    )


def standardised(name: str, scale: Scale):
    """(x − mean) / std; a constant column becomes 0."""
    spread = scale.std[name] or 1.0
    return (ref(name) - F.lit(scale.mean[name])) / F.lit(spread)


def apply_scale(df: DataFrame, scale: Scale) -> DataFrame:
    return df.select(*[standardised(c, scale).alias(c) if c in scale.mean else ref(c) for c in df.columns])


def one_hot(df: DataFrame, column: str, key: str, levels: list[str]) -> DataFrame:
    """``key`` and one 0/1 field per level; a missing category has no level."""
    return df.select(
        ref(key),
        *[F.coalesce((ref(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels],
    )


def class_codes(df: DataFrame, label: str) -> DataFrame:
    """``(label, code)``: 0, 1, … in sorted order of the labels.

    Labels are few (a class target); they are numbered on their distinct set.
    """
    labels = [r[0] for r in df.where(ref(label).isNotNull()).select(ref(label)).distinct().orderBy(ref(label)).limit(MAX_LEVELS + 1).collect()]
    if len(labels) > MAX_LEVELS:
        raise ValueError(f"{label} has more than {MAX_LEVELS} classes; no classifier is trained for it")
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(labels)], f"label {kind}, code int")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, weight)`` = rows / (classes · rows of the class)."""
    counts = df.groupBy(ref(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return counts.select("label", (F.lit(totals["rows"]) / (F.lit(totals["classes"]) * F.col("n"))).alias("weight"))


class Encoder:
    """Scaled numbers and one-hot categories in one vector column ``features``."""

    def __init__(self, numeric: list[str], categorical: list[str]):
        self.numeric, self.categorical = numeric, categorical

    def fit_levels(self, df: DataFrame) -> "Encoder":
        """Learn the levels of the categories on the whole table."""
        self.indexer = None
        self.names = list(self.numeric)
        if self.categorical:
            sizes = {r["column"]: r["n_distinct"] for r in entropies(distinct_counts(df, self.categorical)).collect()}
            wide = [c for c, n in sizes.items() if n > MAX_LEVELS]
            if wide:
                raise ValueError(f"one-hot of {wide} needs more than {MAX_LEVELS} levels; leave the column out")
            indexer = StringIndexer(
                inputCols=self.categorical,
                outputCols=[f"__i{k}" for k in range(len(self.categorical))],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
            self.indexer = indexer.fit(df)
            for c, labels in zip(self.categorical, self.indexer.labelsArray):
                self.names += [f"{c}_{v}" for v in labels]
        return self

    def vectors(self, df: DataFrame, scale: Scale) -> DataFrame:
        out = apply_scale(df, scale)
        inputs = list(self.numeric)
        if self.indexer is not None:
            out = self.indexer.transform(out)
            sizes = [len(labels) for labels in self.indexer.labelsArray]
            encoder = OneHotEncoder(
                inputCols=[f"__i{k}" for k in range(len(sizes))],
                outputCols=[f"__v{k}" for k in range(len(sizes))],
                dropLast=True,  # the last index is "no level", kept by the indexer
            )
            out = encoder.fit(out).transform(out)
            inputs += [f"__v{k}" for k in range(len(sizes))]
        out = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(out)
        return out.drop(*[c for c in out.columns if c.startswith(("__i", "__v"))])


def prepared(
    df: DataFrame,
    target: str,
    key: str,
    leakage: list[str] | None = None,
    ratios: dict[str, float] | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rows with a known target and only the modelling columns, NaN as NULL."""
    clean = nan_to_null(df).where(ref(target).isNotNull())
    if ratios is None:
        ratios = cardinality(clean, column_groups(df, target)["categorical"])
    columns = modelling_columns(df, target, leakage or [], ratios, key)
    keep = [key, target] if key != target else [key]
    return clean.select(*[ref(c) for c in keep + columns["numeric"] + columns["categorical"]]), columns
