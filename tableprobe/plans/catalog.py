"""The catalog of known datasets: vectors, merging and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import ref
from tableprobe.functions.scalars import similarity
from tableprobe.functions.vectors import FEATURE_ORDER, feature_values, order_fingerprint, pad
from tableprobe.operators.neighbours import TOP_K, nearest
from tableprobe.operators.preparation import Scale, fit_scale, standardised
from tableprobe.operators.service import matching, merge_on

# The fields a repeated load may change.
MUTABLE = ["vector", "vector_order", "meta_features", "is_active", "n_rows", "n_cols", "updated_at"]


def feature_table(profiles: DataFrame) -> DataFrame:
    """Profile rows with the ordered features as columns f0 … f15."""
    values = [v.alias(f"f{i}") for i, v in enumerate(feature_values())]
    keep = [c for c in profiles.columns if c in ("dataset", "title", "task_type_code")]
    return profiles.select(*keep, *values)


def feature_names() -> list[str]:
    return [f"f{i}" for i in range(len(FEATURE_ORDER))]


def fit_feature_scale(features: DataFrame) -> Scale:
    return fit_scale(features, feature_names())


def embed(profiles: DataFrame, scale: Scale) -> DataFrame:
    """Profile rows plus the scaled, zero-padded vector and the fingerprint of its order."""
    values = profiles.select("*", *[v.alias(f"f{i}") for i, v in enumerate(feature_values())])
    vector = pad(F.array(*[standardised(n, scale) for n in feature_names()]))
    return values.withColumn("vector", vector).withColumn("vector_order", order_fingerprint()).drop(*feature_names())


def usable(catalog: DataFrame) -> DataFrame:
    """Catalog rows whose vector has the current feature order; others raise."""
    stale = catalog.where(~ref("vector_order").eqNullSafe(order_fingerprint())).limit(1).count()
    if stale:
        raise ValueError("the catalog holds vectors of another feature order; load it again")
    return catalog


def load_catalog(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Merge entries by title: new ones come in, known ones change only mutable fields."""
    return merge_on(catalog, entries, "title", [c for c in MUTABLE if c in catalog.columns])


def similar_datasets(
    queries: DataFrame,
    catalog: DataFrame,
    task_type: str | None = None,
    k: int = TOP_K,
    metric: str = "cosine",
    query_id: str = "id",
    catalog_id: str = "id",
    vector: str = "vector",
) -> DataFrame:
    """The ``k`` nearest active catalog entries per query, optionally of one task."""
    pool = matching(catalog, is_active=True, task_type_code=task_type)
    found = nearest(queries, pool, metric=metric, k=k, query_id=query_id, catalog_id=catalog_id, vector=vector)
    return found.withColumn("similarity", similarity(F.col("distance")))
