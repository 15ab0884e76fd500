"""Size, types, missing cells and duplicate rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import nan_to_null, ref

# Row hashes replace the row in the duplicate shuffle once rows are wide or hold text.
NARROW_ROW_COLUMNS = 6
BYTES_PER_MB = 1024 * 1024


def _cell_bytes(field: T.StructField) -> Column:
    """Bytes one cell takes: fixed by type, or the length of the text."""
    name, kind = ref(field.name), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)).cast("long")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)).cast("long")
    widths = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    return F.lit(widths.get(type(kind), 8)).cast("long")


def type_counts(df: DataFrame) -> dict[str, int]:
    """How many columns have each type."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    return counts


def structure_aggregates(df: DataFrame) -> list[Column]:
    """Aggregates n_rows and memory_mb (data bytes, not engine memory)."""
    fixed = [f for f in df.schema.fields if not _variable(f.dataType)]
    variable = [f for f in df.schema.fields if _variable(f.dataType)]
    row_bytes = sum((_cell_bytes(f) for f in variable), F.lit(0).cast("long"))
    fixed_bytes = sum((_cell_bytes(f) for f in fixed), F.lit(0).cast("long"))
    n = F.count(F.lit(1))
    total = F.coalesce(F.sum(row_bytes), F.lit(0)) + n * fixed_bytes
    return [n.alias("n_rows"), (total / BYTES_PER_MB).alias("memory_mb")]


def structure(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, memory_mb."""
    found = df.agg(*structure_aggregates(df))
    return found.withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def _variable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def missing_by_column(df: DataFrame) -> DataFrame:
    """One row per column: n_missing and its share of all rows. One scan."""
    clean = nan_to_null(df)
    counted = clean.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(ref(c)).alias(f"__{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("__rows").alias("n_rows"),
            (F.col("__rows") - F.col(f"__{i}")).alias("n_missing"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*rows))).withColumn(
        "missing_pct", F.col("n_missing") / F.greatest(F.col("n_rows"), F.lit(1))
    )


def missing_totals(by_column: DataFrame) -> DataFrame:
    """Share of missing cells over the table and the worst column."""
    cells = F.sum("n_rows")
    return by_column.agg(
        (F.sum("n_missing") / F.greatest(cells, F.lit(1))).alias("total_missing_pct"),
        F.coalesce(F.max("missing_pct"), F.lit(0.0)).alias("max_col_missing_pct"),
    )


def row_key(df: DataFrame) -> list[Column]:
    """A 128-bit key of a whole row (two seeds) and the pattern of its NULLs.

    The hash skips NULLs, so the pattern tells (NULL, x) from (x, NULL).
    """
    values, nulls = [], []
    for field in df.schema.fields:
        value = ref(field.name)
        nulls.append(F.when(value.isNull(), "1").otherwise("0"))
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0)  # -0.0 and 0.0 are one value
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        values.append(value)
    return [
        F.xxhash64(F.lit(1), *values).alias("key_a"),
        F.xxhash64(F.lit(2), *values).alias("key_b"),
        F.xxhash64(F.concat(*nulls)).alias("key_nulls"),
    ]


def row_groups(df: DataFrame) -> DataFrame:
    """``copies`` for every distinct row, NULL equal to NULL.

    Wide rows and rows with text are shuffled as keys of three longs, and Spark adds up the
    copies on the map side, so one row repeated over a third of the table costs one record
    per task.
    """
    clean = nan_to_null(df)
    kinds = [f.dataType for f in df.schema.fields]
    if len(kinds) <= NARROW_ROW_COLUMNS and not any(_variable(k) for k in kinds):
        grouped = clean.groupBy(*[ref(c) for c in df.columns])
    else:
        grouped = clean.select(*row_key(clean)).groupBy("key_a", "key_b", "key_nulls")
    return grouped.agg(F.count(F.lit(1)).alias("copies"))


def duplicates(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_duplicates (first copy not counted), duplicate_rows_pct."""
    total = F.coalesce(F.sum("copies"), F.lit(0))
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return row_groups(df).agg(
        total.alias("n_rows"),
        extra.alias("n_duplicates"),
        F.coalesce(F.try_divide(extra, total), F.lit(0.0)).alias("duplicate_rows_pct"),
    )
