"""Mixing sources to target weights, in DataFrame functions only.

Shares: p = tokens of a source over all tokens. Temperature: weights are p^a over their sum. The
exponent a in [0, 1] is the largest multiple of one millionth whose weights reach a target entropy
(a share of the greatest possible one), raised where a source would otherwise be repeated more
often than a limit allows; it is found by bisection over sums of the source table.

Realisation: a source gets floor(weight * budget) tokens: so many whole epochs, then a part of one
more. Each epoch is a block permutation: documents lie in blocks by a hash, blocks are ordered by
a hash of the epoch, and so are the documents in a block. The last epoch ends before the document
that would exceed the budget. That end is found from sums per block and then inside one block per
source, so a source with a third of all rows is spread over all tasks; afterwards each document
sees from one row per source how often it is taken, without a shuffle of texts.

Defined results: NULL and empty sources are one source. NULL and empty texts have no tokens; they
are taken with their block, a source without tokens is not taken at all. Rows without an id are
placed by a hash of their text; repeated rows are taken or left together. An empty table gives an
empty table. Where the budget is beyond the repetition limit for the corpus as a whole, no weights can
meet both: the exponent is 1, all sources are repeated alike and a warning says so. Input columns are numbered while the mix is computed, so any names work; where
one has the name of an added column, the added one gets further underscores.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableprobe.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
STEPS = 1_000_000  # the exponent is a whole number of these
SECTION = 100  # exponents tried per pass
TARGET_ENTROPY = 0.95
MAX_REPEAT = 4.0
BLOCK_DOCS = 4096
BROADCAST_SOURCES = 50_000
SALTS = 64
SEED = 7


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACES), "")).cast("long")


def _named(df: DataFrame, key: str, text: str, source: str) -> tuple[Column, Column]:
    """(source, name of the row in a permutation)."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    return F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), name


def exponent(sources: DataFrame, total: int, count: int, budget: int, target_entropy: float, max_repeat: float) -> float:
    """The exponent; ``sources`` has ``tokens_`` > 0, ``count`` rows with ``total`` tokens."""
    share = F.col("tokens_") / F.lit(float(total))

    def lowest_failing(fails, low: int, high: int) -> int:
        """Least step in (low, high] that fails, if ``high`` does and failing is monotone."""
        while high - low > 1:
            width = max(1, (high - low) // SECTION)
            tried = list(range(low + width, high, width))
            row = sources.agg(*[fails(step / STEPS).alias(f"s{n}") for n, step in enumerate(tried)]).first()
            bad = [step for n, step in enumerate(tried) if row[n]]
            good = [step for n, step in enumerate(tried) if not row[n]]
            low, high = max(good, default=low), min(bad, default=high)
        return high

    def sums(a: float) -> tuple[Column, Column]:
        power = F.pow(share, F.lit(a))
        return F.sum(power), F.sum(power * F.log(power))

    def too_even(a: float) -> Column:
        """Entropy below the target: -sum w log w with w = power / z."""
        z, zlog = sums(a)
        return (F.log(z) - zlog / z) < F.lit(target_entropy * math.log(count))

    def repeats_fit(a: float) -> Column:
        z, _ = sums(a)
        most = F.max(F.pow(share, F.lit(a - 1.0)))
        return F.lit(budget / total) * most / z <= F.lit(max_repeat)

    # Entropy falls with the exponent: the last one that reaches the target.
    whole = sources.agg(too_even(1.0).alias("e"), repeats_fit(0.0).alias("r")).first()
    by_entropy = STEPS if not whole.e else lowest_failing(too_even, 0, STEPS) - 1
    # Repetition falls with it too: the first one that fits.
    by_repeat = 0 if whole.r else lowest_failing(repeats_fit, 0, STEPS)
    return max(by_entropy, by_repeat) / STEPS


def _with_sources(rows: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """Rows with the columns of their source: broadcast if few sources, else a salted join."""
    if count <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), "source_", "left")
    salted = table.withColumn("salt_", F.explode(F.array(*[F.lit(n) for n in range(SALTS)])))
    return rows.withColumn("salt_", F.pmod(F.xxhash64("name_"), F.lit(SALTS)).cast("int")).join(salted, ["source_", "salt_"], "left").drop("salt_")


def _block(name: Column, blocks: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("block"), name)), 1, 8), 16, 10).cast("long") % blocks


def _order(seed: int, epoch: Column, what: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), what.cast("string")))


def plan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget: int | None = None,
    target_entropy: float = TARGET_ENTROPY,
    max_repeat: float = MAX_REPEAT,
    seed: int = SEED,
    block_docs: int = BLOCK_DOCS,
) -> tuple[DataFrame, int]:
    """One row per source, and how many there are.

    Columns: source_, docs_, tokens_, weight_, goal_ (tokens), epochs_ (whole ones), blocks_, and
    the end of the part of one more: cut_block_ (order of the last block) and cut_doc_ (order of
    the last document in it).
    """
    from_source, name = _named(df, key, text, source)
    rows = cut_lineage(df.select(from_source.alias("source_"), name.alias("name_"), word_count(F.col(f"`{text}`")).alias("n_")))
    sources = cut_lineage(rows.groupBy("source_").agg(F.count("*").alias("docs_"), F.sum("n_").alias("tokens_")))
    known = sources.where("tokens_ > 0")
    size = sources.agg(F.count("*").alias("all"), F.sum(F.col("tokens_")).alias("t"), F.count_if(F.col("tokens_") > 0).alias("n")).first()
    total = size.t or 0
    goal = total if budget is None else budget
    if total and goal > max_repeat * total:
        warnings.warn(f"a budget of {goal} tokens repeats the {total} of the corpus more than {max_repeat} times", stacklevel=2)
    a = exponent(known, total, size.n, goal, target_entropy, max_repeat) if total else 1.0
    z = known.agg(F.sum(F.pow(F.col("tokens_") / F.lit(float(total or 1)), F.lit(a)))).first()[0] or 1.0
    has = F.col("tokens_") > 0
    weight = F.when(has, F.pow(F.col("tokens_") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    table = (
        sources.withColumn("weight_", weight)
        .withColumn("goal_", F.floor(F.round(F.col("weight_") * F.lit(float(goal)), 3)).cast("long"))
        .withColumn("epochs_", F.when(has, F.floor(F.col("goal_") / F.col("tokens_"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest_", F.col("goal_") - F.col("epochs_") * F.col("tokens_"))
        .withColumn("blocks_", F.ceil(F.col("docs_") / F.lit(block_docs)).cast("long"))
    )
    last = F.col("epochs_") + 1
    placed = _with_sources(rows, table, size.all).where(F.col("rest_") > 0).withColumn("block_", _block(F.col("name_"), F.col("blocks_")))
    by_block = placed.groupBy("source_", "block_").agg(
        F.sum("n_").alias("n_"), F.first("rest_").alias("rest_"), F.first(last).alias("last_")
    ).withColumn("at_", _order(seed, F.col("last_"), F.concat_ws("/", "source_", F.col("block_").cast("string"))))
    until = W.partitionBy("source_").orderBy("at_", "block_").rowsBetween(W.unboundedPreceding, 0)
    # The block in which the budget ends: the first whose sum exceeds it.
    ends = by_block.withColumn("sum_", F.sum("n_").over(until)).where(F.col("sum_") > F.col("rest_"))
    end = ends.groupBy("source_").agg(F.min(F.struct("sum_", "at_", "block_", (F.col("rest_") - F.col("sum_") + F.col("n_")).alias("left_"))).alias("e_")).select(
        "source_", F.col("e_.at_").alias("cut_block_"), F.col("e_.block_").alias("cut_at_"), F.col("e_.left_").alias("left_")
    )
    table = cut_lineage(table.join(end, "source_", "left"))
    inside = _with_sources(rows, table, size.all).where(F.col("cut_at_") == _block(F.col("name_"), F.col("blocks_")))
    order = inside.select("source_", "n_", "left_", _order(seed, last, F.col("name_")).alias("doc_"))
    so_far = F.sum("n_").over(W.partitionBy("source_").orderBy("doc_"))  # rows of one place count together
    cut = order.withColumn("sum_", so_far).where(F.col("sum_") <= F.col("left_")).groupBy("source_").agg(F.max("doc_").alias("cut_doc_"))
    columns = ["source_", "docs_", "tokens_", "weight_", "goal_", "epochs_", "blocks_", "cut_block_"]
    return cut_lineage(table.select(*columns).join(cut, "source_", "left")), size.all


def mix(df: DataFrame, sources: DataFrame, count: int, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Every row of ``df`` as often as it is taken, with its columns and four more.

    source_, epoch_, block_ and place_: rows of a source and epoch in the order of ``place_`` are
    its block permutation.
    """
    position = {c.lower(): n for n, c in enumerate(df.columns)}
    numbered = df.toDF(*[f"c{n}" for n in range(len(df.columns))])
    from_source, name = _named(numbered, *[f"c{position[c.lower()]}" for c in (key, text, source)])
    rows = _with_sources(numbered.withColumns({"source_": from_source, "name_": name}), sources, count)
    rows = rows.withColumn("block_", _block(F.col("name_"), F.col("blocks_")))
    where = F.concat_ws("/", F.col("source_"), F.col("block_").cast("string"))
    last = F.col("epochs_") + 1
    in_order = _order(seed, last, where)
    part = (in_order < F.col("cut_block_")) | ((in_order == F.col("cut_block_")) & (_order(seed, last, F.col("name_")) <= F.col("cut_doc_")))
    copies = F.col("epochs_") + F.coalesce(part, F.lit(False)).cast("long")
    epochs = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    taken = rows.withColumn("epoch_", F.explode(epochs))
    place = F.concat(_order(seed, F.col("epoch_"), where), _order(seed, F.col("epoch_"), F.col("name_")))
    added = {"source_": F.col("source_"), "epoch_": F.col("epoch_"), "block_": F.col("block_"), "place_": place}
    out = [F.col(f"c{n}").alias(c) for n, c in enumerate(df.columns)]
    for column, value in added.items():
        while column in position:
            column += "_"
        position[column] = -1
        out.append(value.alias(column))
    return taken.select(*out)
