"""Reproducible samples, ranks and folds by the hash of a row key.

A rank inside a class is never computed by sorting the class in one task: rows fall into
hash buckets, counts per bucket give each bucket its first rank, and only the rows of one
bucket are ordered together. Hash buckets are even, whatever the size of the class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import ref
from tableprobe.session import cut_lineage

# Row limits of the profile sample and of the training sample.
PROFILE_SAMPLE = 50_000
TRAINING_SAMPLE = 5_000
FOLDS = 5

ROWS_PER_BUCKET = 200_000
BROADCAST_CLASSES = 100_000


def hash_of(key: Column) -> Column:
    """Sort key of the sampling order: md5 of the key as text."""
    return F.md5(key.cast("string").cast("binary"))


def _bucket(hashed: Column, n_rows: int) -> tuple[Column, int]:
    bits = max(0, math.ceil(math.log2(max(n_rows, 1) / ROWS_PER_BUCKET)))
    top = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")  # 32 bits: room for any table
    return F.shiftright(top, max(0, 32 - bits)), 2**bits


def rank_in_class(df: DataFrame, label: str, key: str, n_rows: int | None = None) -> DataFrame:
    """``class_rank``: 1, 2, … inside each label in the order of the key's hash, and ``class_size``.

    Rows without a label are left out. The window and the join share their partitioning.
    """
    n_rows = df.count() if n_rows is None else n_rows
    hashed = df.where(ref(label).isNotNull()).withColumn("__hash", hash_of(ref(key)))
    bucket, _ = _bucket(F.col("__hash"), n_rows)
    rows = hashed.withColumn("__bucket", bucket)
    sizes = rows.groupBy(ref(label).alias("__label"), "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__label").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__label")
    offsets = sizes.select(
        "__label",
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("class_size"),
    )
    inside = Window.partitionBy(ref(label), "__bucket").orderBy("__hash", ref(key))
    placed = rows.withColumn("__inside", F.row_number().over(inside))
    joined = placed.join(offsets, (ref(label) == F.col("__label")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("class_rank", F.col("__before") + F.col("__inside")).drop(
        "__hash", "__bucket", "__inside", "__label", "__b", "__before"
    )


def hash_level(number: Column) -> Column:
    """Bit length of a non-negative hash: halving a level halves the rows at or below it."""
    return F.floor(F.log2(number.cast("double") + 1)).cast("int")


def random_sample(df: DataFrame, key: str, size: int = PROFILE_SAMPLE) -> DataFrame:
    """Exactly ``size`` rows (or all), those with the smallest key hash.

    Counts per bit length of the hash (61 numbers) tell from which length on rows cannot be
    in the sample; about twice ``size`` rows remain to be ordered, however large the table.
    """
    hashed = df.withColumn("__hash", hash_of(ref(key)))
    level = hash_level(F.conv(F.substring(F.col("__hash"), 1, 15), 16, 10).cast("long"))
    total, last = 0, None
    for row in hashed.groupBy(level.alias("level")).count().orderBy("level").collect():
        total, last = total + row["count"], row["level"]
        if total >= size:
            break
    if total <= size:
        kept = hashed if last is None or total < size else hashed.where(level <= last)
        return kept.drop("__hash")
    return hashed.where(level <= last).orderBy("__hash", ref(key)).limit(size).drop("__hash")


def stratified_sample(df: DataFrame, label: str, key: str, size: int) -> DataFrame:
    """About ``size`` rows (or all), the same share of every class; rows without a label fall out.

    The last row to be taken is found per class from labels and keys alone; whole rows are only
    filtered by it, which needs no shuffle of them. Rows of one key stay together.
    """
    n_rows = df.count()
    share = min(1.0, size / max(n_rows, 1))
    ranked = rank_in_class(df.select(ref(label).alias("__of"), ref(key).alias("__key")), "__of", "__key", n_rows)
    last = cut_lineage(
        ranked.where(F.col("class_rank") == F.rint(F.col("class_size") * share)).select(
            "__of", F.struct(hash_of(F.col("__key")).alias("hash"), F.col("__key").alias("key")).alias("__last")
        )
    )
    if last.count() <= BROADCAST_CLASSES:
        last = F.broadcast(last)
    here = F.struct(hash_of(ref(key)).alias("hash"), ref(key).alias("key"))
    taken = df.join(last, (ref(label) == F.col("__of")) & (here <= F.col("__last")))
    return taken.select(*[ref(c) for c in df.columns])


def sampled(
    df: DataFrame,
    key: str,
    label: str | None = None,
    threshold: int = PROFILE_SAMPLE,
    size: int = PROFILE_SAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """The table, or a sample of it above ``threshold`` rows, and the record of what was done.

    With ``label`` (a class target) the sample keeps the class shares.
    """
    n_rows = df.count()
    take = n_rows > threshold
    if not take:
        part = df
    elif label is None:
        part = random_sample(df, key, size)
    else:
        part = stratified_sample(df, label, key, size)
    record = part.agg(
        F.lit(take).alias("sampled"),
        F.count(F.lit(1)).alias("sample_size"),
        F.lit(n_rows).cast("long").alias("original_size"),
    )
    return part, record


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = FOLDS) -> DataFrame:
    """``fold`` 0 … folds−1, dealt round-robin inside each class in hash order."""
    ranked = rank_in_class(df, label, key)
    return ranked.withColumn("fold", ((F.col("class_rank") - 1) % folds).cast("int")).drop(
        "class_rank", "class_size"
    )


def plain_folds(df: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """``fold`` from the key's hash: no shuffle, fold sizes equal up to chance."""
    part = F.conv(F.substring(hash_of(ref(key)), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (part % folds).cast("int"))
