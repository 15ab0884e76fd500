"""Joins, pages and counts over the service tables (owners, runs, results, catalog)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import ref

# Order of the severities in a list of flags.
SEVERITY_ORDER = ("critical", "warning", "info")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; a value of None means the column is not tested."""
    tests = [ref(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def among(df: DataFrame, column: str, keys: DataFrame | list) -> DataFrame:
    """Membership: literals as ``IN``, a table of keys as a semi join."""
    if isinstance(keys, list):
        return df.where(ref(column).isin(keys))
    return df.join(keys.select(ref(keys.columns[0]).alias(column)), column, "left_semi")


def with_lookup(df: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join on ``key``; fields without a match get their default."""
    joined = df.join(lookup.select(key, *defaults), key, "left")
    return joined.select(*df.columns, *[F.coalesce(ref(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def with_child_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One count per parent and child table, zero kept; children are counted before the join."""
    out = parents
    for name, (table, foreign) in children.items():
        counted = table.groupBy(ref(foreign).alias(key)).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(ref(name), F.lit(0)))
    return out


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the first by the text of its fields."""
    order = Window.partitionBy(ref(key)).orderBy(F.to_json(F.struct(*[ref(c) for c in df.columns])))
    return df.withColumn("__k", F.row_number().over(order)).where(F.col("__k") == 1).drop("__k")


def merge_on(old: DataFrame, new: DataFrame, key: str, mutable: list[str]) -> DataFrame:
    """Insert rows with a new key; for a known key overwrite only the ``mutable`` fields.

    Of new rows with the same key one is used.
    """
    o = old.select(ref(key), F.struct(*old.columns).alias("__old"))
    n = one_per_key(new, key).select(ref(key), F.struct(*new.columns).alias("__new"))
    joined = o.join(n, key, "full_outer")
    fields = []
    for c in old.columns:
        if c == key:
            fields.append(ref(key))
            continue
        before, after = F.col("__old").getField(c), F.col("__new").getField(c)
        take_new = F.col("__old").isNull() | (F.lit(c in mutable) & F.col("__new").isNotNull())
        fields.append(F.when(take_new, after).otherwise(before).alias(c))
    return joined.select(*fields)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` plus the rows of ``new`` whose key is not there yet, one per key."""
    return old.unionByName(one_per_key(new, key).join(old.select(key), key, "left_anti").select(*old.columns))


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that hang off the keys in ``gone``."""
    key = gone.columns[0]
    return {
        name: table.join(gone.select(ref(key).alias(foreign)), foreign, "left_anti").select(*table.columns)
        for name, (table, foreign) in tables.items()
    }


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in the given order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int, at_least: int = 0) -> DataFrame:
    """Row total and page count under the same filter as the page itself."""
    total = F.count(F.lit(1))
    pages = F.greatest(F.ceil(total / F.lit(size)).cast("long"), F.lit(at_least).cast("long"))
    return df.agg(total.alias("total"), pages.alias("pages"))


def severity_rank(severity: Column) -> Column:
    ladder = F.when(F.lit(False), 0)
    for i, name in enumerate(SEVERITY_ORDER):
        ladder = ladder.when(severity == name, i)
    return ladder.otherwise(len(SEVERITY_ORDER))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row per key."""
    window = Window.partitionBy(ref(key)).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(window)).where(F.col("__k") == 1).drop("__k")


def success_counts(df: DataFrame, done: Column) -> DataFrame:
    """``total``, ``done`` and ``success_rate`` (NULL for an empty table) in one scan."""
    total = F.count(F.lit(1))
    good = F.count(F.when(done, 1))
    return df.agg(total.alias("total"), good.alias("done"), F.try_divide(good, total).alias("success_rate"))


def by_severity(flags: DataFrame) -> DataFrame:
    """Flag counts per severity, worst first."""
    counted = flags.groupBy("severity").agg(F.count(F.lit(1)).alias("n_flags"))
    return counted.orderBy(severity_rank(F.col("severity")))
