"""Correlation between numeric columns and mutual information with a target."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import is_numeric, is_temporal, nan_to_null, ref
from tableprobe.operators.categorical import unpivot_text
from tableprobe.operators import states
from tableprobe.operators.order_stats import bin_of, edge_ranks, rank_bin_edges
from tableprobe.operators.target import MAX_CLASS_SHARE, MAX_CLASS_VALUES

MI_BINS = 16
CHUNK = 2  # characters that the first pass tells apart; every further one a character more
LOOK = 32  # characters that the first pass looks ahead; every further one eight times as many
LATE = 4.0e18  # beyond any time in microseconds: where a missing time is put


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, r)`` for every pair a < b in column order; NULL when undefined.

    Each pair uses the rows where both values are present and finite. One scan at any width: every task holds
    co-moments, tiles of them are merged in a tree of tasks, and the pairs come out where the last merge is.
    A column that is constant over the rows of a pair is told by its extremes there.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    return states.correlations_of(states.scan(df, columns, [states.CoMoments()]), columns)


def full_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Both halves and the diagonal in long form, with the column positions."""
    spark = pairs.sparkSession
    order = {c: i for i, c in enumerate(columns)}
    diagonal = spark.createDataFrame([(c, c, 1.0) for c in columns], "column_a string, column_b string, r double")
    mirrored = pairs.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r")
    position = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    both = pairs.unionByName(mirrored).unionByName(diagonal)
    return both.withColumn("position_a", position[F.col("column_a")]).withColumn(
        "position_b", position[F.col("column_b")]
    )


def dense_matrix(long: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column, one field per partner, undefined values as 0."""
    return (
        long.groupBy("column_a")
        .pivot("column_b", columns)
        .agg(F.first("r"))
        .na.fill(0.0, subset=columns)
    )


def top_correlated(long: DataFrame, k: int) -> DataFrame:
    """The ``k`` columns with the largest sum of |r| to the others, in column order."""
    weight = F.sum(F.when(F.col("column_a") != F.col("column_b"), F.abs("r")).otherwise(0.0))
    return (
        long.groupBy("column_a", "position_a")
        .agg(F.coalesce(weight, F.lit(0.0)).alias("weight"))
        .orderBy(F.desc("weight"), F.desc("position_a"))
        .limit(k)
        .orderBy("position_a")
    )


def submatrix(long: DataFrame, kept: DataFrame) -> DataFrame:
    """The long matrix restricted to the kept columns on both sides."""
    rows = kept.select("column_a")
    cols = kept.select(F.col("column_a").alias("column_b"))
    return long.join(rows, "column_a", "left_semi").join(cols, "column_b", "left_semi")


def target_correlations(pairs: DataFrame, target: str) -> DataFrame:
    """``(column, abs_r)`` of every numeric feature with a numeric target."""
    other = F.when(F.col("column_a") == target, F.col("column_b")).otherwise(F.col("column_a"))
    return pairs.where((F.col("column_a") == target) | (F.col("column_b") == target)).select(
        other.alias("column"), F.abs("r").alias("abs_r")
    )


# ---- mutual information -------------------------------------------------------------


@dataclass
class BinFacts:
    """What a profile already knows for :func:`mutual_information`, over the rows whose target is known."""

    few: set[str]  # features with at most so many values as there are bins, gaps filled
    number_edges: dict[str, list[float]]  # of the other numbers and times, gaps filled, and of a binned target
    binned_target: bool


def filled_ranks(c: str, n: int, negative: int, gaps: int, late: bool, bins: int) -> tuple[list, list[int]]:
    """Equal-count edges of a column whose gaps are filled, by the ranks of its finite values.

    Gaps are zeros, which stand in front of what is not negative, or ``late``, behind everything. Gives the edges,
    a rank where the edge is a value of the column, and the list of these ranks.
    """
    start = n if late else negative
    edges, ranks = [], []
    for rank in edge_ranks(n + gaps, bins) if n + gaps else []:
        if start <= rank < start + gaps:
            edges.append((LATE if late else 0.0, None))
        else:
            ranks.append(rank if rank < start else rank - gaps)
            edges.append((None, ranks[-1]))
    return edges, ranks


def mutual_information(df: DataFrame, target: str, bins: int = MI_BINS, known_facts: BinFacts | None = None) -> DataFrame:
    """``(column, mi)`` in nats between every feature and the target, from exact counts.

    Rows without a target are left out. A missing number counts as 0, any other missing
    value as the text MISSING. A feature with more than ``bins`` distinct values is cut into
    equal-count bins by its sorted order; so is a regression target.
    """
    known = nan_to_null(df).where(ref(target).isNotNull())
    features = [f for f in df.schema.fields if f.name != target]
    if not features:
        return df.sparkSession.createDataFrame([], "column string, mi double")
    y_field = next(f for f in df.schema.fields if f.name == target)
    y_number = is_numeric(y_field.dataType)
    numbers = {f.name for f in features if is_numeric(f.dataType)}
    times = {f.name for f in features if is_temporal(f.dataType)}
    texts = [f.name for f in features if f.name not in numbers | times]
    filled = known.select(
        *[F.coalesce(ref(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers],
        *[_micros(c).alias(c) for c in times],
        *[F.coalesce(ref(c).cast("string"), F.lit("MISSING")).alias(c) for c in texts],
        (ref(target).cast("double") if y_number else ref(target).cast("string")).alias(target),
    )
    names = [f.name for f in features]
    if known_facts:
        facts = known_facts
        return _binned_information(filled, names, texts, target, bins, facts.few, facts.number_edges, facts.binned_target)
    # Distinct values are estimated on hashes: no number has to be written out as text.
    hashes = filled.select(*[F.xxhash64(ref(c)).alias(c) for c in [*names, target]])
    estimates = (
        hashes.unpivot([], [ref(c) for c in hashes.columns], "column", "value")
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("value").alias("d"))
        .collect()
    )
    if not estimates or estimates[0]["rows"] < 2:
        # One known row says nothing about a relation.
        return df.sparkSession.createDataFrame([(c, None) for c in names], "column string, mi double")
    approx = {e["column"]: e["d"] for e in estimates}
    limit = max(MAX_CLASS_VALUES, int(MAX_CLASS_SHARE * estimates[0]["rows"]))
    check = [c for c in names if approx.get(c, 0) <= 4 * bins]
    y_close = y_number and approx.get(target, 0) >= limit / 2
    # Exact distinct counts only where the estimate is near a limit.
    exact = dict(
        unpivot_text(filled, check + ([target] if y_close else []))
        .groupBy("column", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("d"))
        .collect()
    ) if check or y_close else {}
    few = {c for c in check if exact.get(c, 0) <= bins}
    y_binned = y_close and exact[target] > limit
    number_edges = rank_bin_edges(
        filled, [c for c in names if c not in few and c not in texts] + ([target] if y_binned else []), bins
    )
    return _binned_information(filled, names, texts, target, bins, few, number_edges, y_binned)


def _binned_information(filled, names, texts, target, bins, few, number_edges, y_binned) -> DataFrame:
    text_edges = text_bin_edges(filled, [c for c in texts if c not in few], bins)
    cells = []
    for c in names:
        value = ref(c)
        if c in few:
            cells.append(value.cast("string").alias(c))
        else:
            edges = text_edges[c] if c in texts else number_edges[c]
            cells.append(bin_of(value, edges).cast("string").alias(c))
    y = bin_of(ref(target), number_edges[target]) if y_binned else ref(target)
    return information(filled.select(*cells, y.cast("string").alias("__y")), names)


def micros(name: str) -> Column:
    """A time as microseconds, NULL when missing."""
    return F.unix_micros(ref(name).try_cast("timestamp")).cast("double")


def _micros(name: str) -> Column:
    return F.coalesce(micros(name), F.lit(LATE))


def information(binned: DataFrame, names: list[str]) -> DataFrame:
    """Plug-in mutual information of every named text column with ``__y``.

    I = H(x) + H(y) − H(x, y); each entropy is one sum over grouped counts, so no counts
    are joined to each other and no total has to be known first.
    """
    joint = (
        binned.unpivot(["__y"], [ref(c) for c in names], "column", "x")
        .groupBy("column", "x", "__y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = F.col("n")
    # The three tables of counts (x and y, x, y) in one more shuffle of already small counts.
    sides = joint.select(
        "column",
        F.stack(F.lit(3), F.lit("xy"), F.col("x"), F.col("__y"), F.lit("x"), F.col("x"), F.lit(None), F.lit("y"), F.lit(None), F.col("__y"))
        .alias("side", "a", "b"),
        "n",
    )
    summed = sides.groupBy("column", "side", "a", "b").agg(F.sum("n").alias("n"))

    def spread_of(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, n * F.ln(n)).otherwise(0.0))

    total = F.sum(F.when(F.col("side") == "xy", n).otherwise(0))
    mi = F.ln(total) + (spread_of("xy") - spread_of("x") - spread_of("y")) / total
    return summed.groupBy("column").agg(F.greatest(F.lit(0.0), mi).alias("mi"))


def text_bin_edges(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[str]]:
    """Edges of equal-count bins over the sorted order of text columns, exact.

    Radix selection from the first character on: a pass counts the next few characters of the values that
    share a wanted rank's prefix and so makes the prefix longer. What all values of a cell go on with is added at
    once, as far as the pass looks ahead: the first one, over all rows, a little, each further one, over the rows
    around the wanted ranks alone, eight times as far. Long common starts thus take few passes. Shuffled are counts of
    short pieces with the two outer texts of each, never the column; the driver sees one row per rank.
    """
    if not columns:
        return {}
    long = df.select(*[ref(c).alias(c) for c in columns]).unpivot([], [ref(c) for c in columns], "column", "value")
    sizes = {r["column"]: r["n"] for r in long.groupBy("column").agg(F.count("value").alias("n")).collect()}
    edges: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    # (column, prefix): the ranks wanted among the values that start with it.
    open_ = {(c, ""): sorted(set(edge_ranks(sizes[c], bins))) for c in columns if sizes.get(c)}
    placed = {(c, ""): 0 for c in columns}
    chunk, look = CHUNK, LOOK
    while open_:
        open_, placed = _longer_prefixes(long, open_, placed, edges, chunk, look)
        chunk, look = chunk + 1, min(8 * look, 1 << 30)
    found = {c: dict(v) for c, v in edges.items()}
    return {c: [found[c][r] for r in edge_ranks(sizes[c], bins)] if sizes.get(c) else [] for c in columns}


def _longer_prefixes(long: DataFrame, open_: dict, placed: dict, edges: dict, chunk: int, look: int) -> tuple[dict, dict]:
    """One pass: ranks of values that are known go to ``edges``, the others get a longer prefix.

    ``open_`` has the wanted ranks inside each prefix, ``placed`` the number of values below it.
    """
    spark = long.sparkSession
    keys = list(open_)
    table = spark.createDataFrame([(c, k, p) for k, (c, p) in enumerate(keys)], "column string, part long, prefix string")
    rest = F.substr(F.col("value"), F.char_length("prefix") + 1, F.lit(look))
    # At most one row per rank is sent to the values.
    inside = long.join(F.broadcast(table), "column").where(F.startswith("value", "prefix")).select("part", rest.alias("look"))
    cells = inside.groupBy("part", F.substring("look", 1, chunk).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("look").alias("least"), F.max("look").alias("most"))
    so_far = Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # cells of a few characters
    wanted = [(k, r) for k, key in enumerate(keys) for r in open_[key]]
    ranks = F.broadcast(spark.createDataFrame(wanted, "part long, rank long"))
    hits = cells.withColumn("upto", F.sum("n").over(so_far)).join(ranks, "part").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    deeper: dict[tuple[str, str], list[int]] = {}
    below: dict[tuple[str, str], int] = {}
    for r in hits.collect():
        c, prefix = keys[r["part"]]
        before = placed[c, prefix]
        if r["least"] == r["most"] and len(r["least"]) < look:
            edges[c].append((before + r["rank"], prefix + r["least"]))
            continue
        longer = prefix + os.path.commonprefix([r["least"], r["most"]])
        deeper.setdefault((c, longer), []).append(r["rank"] - (r["upto"] - r["n"]))
        below[c, longer] = before + r["upto"] - r["n"]
    return deeper, below


def information_summary(by_column: DataFrame) -> DataFrame:
    """Maximum and mean over the features."""
    return by_column.agg(
        F.max("mi").alias("target_mutual_information_max"),
        F.avg("mi").alias("target_mutual_information_mean"),
    )

