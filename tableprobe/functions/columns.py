"""Column groups by type and the expressions that clean one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def ref(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(
        data_type, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType)
    )


def column_groups(df: DataFrame, target: str | None = None) -> dict[str, list[str]]:
    """Every column in exactly one of numeric / datetime / categorical.

    The target, if given, is kept out.
    """
    groups: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": []}
    for field in df.schema.fields:
        if field.name == target:
            continue
        if is_numeric(field.dataType):
            groups["numeric"].append(field.name)
        elif is_temporal(field.dataType):
            groups["datetime"].append(field.name)
        else:
            groups["categorical"].append(field.name)
    return groups


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing, so it becomes NULL before anything is computed."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.nanvl(ref(c), F.lit(None)).alias(c) if c in floats else ref(c)
            for c in df.columns
        ]
    )


def finite(column: Column) -> Column:
    """The value as double, NULL when missing, NaN or infinite."""
    value = column.cast("double")
    return F.when(F.abs(value) < F.lit(INFINITY), value)


def safe_double(column: Column) -> Column:
    """A finite double; whatever is not one becomes 0.0 (strings are tried as numbers)."""
    return F.coalesce(finite(column.try_cast("double")), F.lit(0.0))


def is_number_label(column: Column) -> Column:
    """True when the text parses as a finite number."""
    return finite(F.trim(column.cast("string")).try_cast("double")).isNotNull()


def json_number(column: Column) -> Column:
    """A number JSON can carry: NaN and infinities become NULL."""
    return F.when(F.abs(column) < F.lit(INFINITY), column)


def json_numbers(column: Column, data_type: T.DataType) -> Column:
    """:func:`json_number` through arrays, maps and structs."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return json_number(column)
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda x: json_numbers(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(column, lambda _, v: json_numbers(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        rebuilt = F.struct(
            *[json_numbers(column.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
        )
        return F.when(column.isNotNull(), rebuilt)
    return column


def json_safe(df: DataFrame) -> DataFrame:
    """All columns of ``df`` with NaN and infinities turned into NULL at any depth."""
    return df.select(*[json_numbers(ref(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
