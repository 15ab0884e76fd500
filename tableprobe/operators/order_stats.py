"""Exact order statistics by radix selection, without sorting a column.

Doubles have a 64-bit number in their order. A pass counts the next twelve bits of the values that
share a wanted rank's prefix, so each rank's prefix grows by twelve bits; at most six passes tell any two
values apart, and a cell that holds one value only is done earlier (two or three passes are typical). Counts
are made inside the tasks, a few thousand per rank and task are shuffled, and the driver sees one row per
rank; of the first pass, which also gives the number of values, the at most 4 096 cells of a column.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import finite, ref
from tableprobe.operators import states


def long_values(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows ``(column, value)`` of the finite values, with the ``keep`` columns repeated."""
    keep = keep or []
    wide = df.select(*[ref(k) for k in keep], *[finite(ref(c)).alias(c) for c in columns])
    long = wide.unpivot([ref(k) for k in keep], [ref(c) for c in columns], "column", "value")
    return long.where(F.col("value").isNotNull())


def first_cells(columns: list[str]) -> states.Cells:
    """The collector of the first pass."""
    return states.Cells(0, [np.zeros(1, np.uint64)] * len(columns), list(range(len(columns))))


def cells_of(rows: DataFrame) -> DataFrame:
    """``part, cell, n, low, high`` added up over all tasks."""
    counted = rows.where(F.col("kind") == states.Cells.kind).groupBy("part", "cell")
    return counted.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def values_at_ranks(df: DataFrame, ranks_for, columns: list[str]) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """The finite values of every column at 0-based ranks.

    ``ranks_for(n)`` gives the wanted ranks for a column of ``n`` finite values. Returns
    the counts and, per column, ``{rank: value}``.
    """
    found = select_ranks(df, lambda _, n, __: ranks_for(n), columns)
    return {c: n for c, (n, _, _) in found.items()}, {c: values for c, (_, _, values) in found.items()}


def select_ranks(df: DataFrame, ranks_of, columns: list[str], first: DataFrame | None = None) -> dict[str, tuple[int, int, dict[int, float]]]:
    """Per column: number of finite values, of negative ones, and ``{rank: value}``.

    ``ranks_of(column, values, negative)`` gives the wanted ranks. ``first`` may carry the rows of a scan
    with :func:`first_cells` over the same columns.
    """
    if not columns:
        return {}
    first = states.scan(df, columns, [first_cells(columns)]) if first is None else first
    cells: dict[int, list] = {}
    for r in cells_of(first).collect():  # at most 4 096 per column
        cells.setdefault(r["part"], []).append((r["cell"], r["n"], r["low"], r["high"]))
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    sizes: dict[str, tuple[int, int]] = {}
    # Per (column, prefix): values below it, and the wanted ranks inside.
    open_: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for i, c in enumerate(columns):
        mine = sorted(cells.get(i, []))
        total, negative = sum(x[1] for x in mine), sum(x[1] for x in mine if x[2] < 0)
        sizes[c] = (total, negative)
        wanted, below = sorted({r for r in ranks_of(c, total, negative) if 0 <= r < total}), 0
        for cell, n, low, high in mine:
            inside = [r for r in wanted if below <= r < below + n]
            if inside and low == high:
                found[c].update({r: low for r in inside})
            elif inside:
                open_[i, cell] = (below, inside)
            below += n
    level = 1
    while open_:
        open_ = _deeper(df, columns, level, open_, found)
        level += 1
    return {c: (*sizes[c], found[c]) for c in columns}


def _deeper(df: DataFrame, columns: list[str], level: int, open_: dict, found: dict) -> dict:
    """One more pass: ranks whose cell holds one value are found, the others get a longer prefix."""
    keys = sorted(open_)
    used = sorted({i for i, _ in keys})
    prefixes = [np.array([p for j, p in keys if j == i], np.uint64) for i in used]
    collector = states.Cells(level, prefixes, [next(k for k, key in enumerate(keys) if key[0] == i) for i in used])
    counted = cells_of(states.scan(df, [columns[i] for i in used], [collector]))
    spark = df.sparkSession
    so_far = Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # a few thousand cells
    ranks = [(k, r - open_[key][0]) for k, key in enumerate(keys) for r in open_[key][1]]
    wanted = F.broadcast(spark.createDataFrame(ranks, "part long, rank long"))  # one row per rank
    placed = counted.withColumn("upto", F.sum("n").over(so_far))
    hits = placed.join(wanted, "part").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    deeper: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in hits.collect():
        i, prefix = keys[r["part"]]
        before = open_[i, prefix][0]
        if r["low"] == r["high"]:
            found[columns[i]][before + r["rank"]] = r["low"]
        else:
            longer = (prefix << collector.width) + r["cell"]
            deeper.setdefault((i, longer), (before + r["upto"] - r["n"], []))[1].append(before + r["rank"])
    return deeper


def quantile_ranks(n: int, shares: list[float]) -> list[int]:
    """The ranks between which the quantiles of ``n`` values lie."""
    spots = [(n - 1) * s for s in shares]
    return [math.floor(p) for p in spots] + [math.ceil(p) for p in spots]


def quantile(n: int, at: dict[int, float], share: float) -> float | None:
    """A quantile with linear interpolation from the values at its ranks."""
    if not n:
        return None
    spot = (n - 1) * share
    low, high = at[math.floor(spot)], at[math.ceil(spot)]
    return low + (high - low) * (spot - math.floor(spot))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, dict[float, float | None]]:
    """Exact quantiles with linear interpolation, per column; None for an empty column."""
    counts, values = values_at_ranks(df, lambda n: quantile_ranks(n, shares), columns)
    return {c: {s: quantile(counts[c], values.get(c, {}), s) for s in shares} for c in columns}


def quantile_table(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """:func:`quantiles` as rows ``(column, share, value)``."""
    rows = [(c, s, v) for c, by in quantiles(df, columns, shares).items() for s, v in by.items()]
    return df.sparkSession.createDataFrame(rows, "column string, share double, value double")


def edge_ranks(n: int, bins: int) -> list[int]:
    """The ranks of the edges of ``bins`` equal-count bins."""
    return [-(-j * n // bins) - 1 for j in range(1, bins)]


def rank_bin_edges(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Edges of ``bins`` equal-count bins.

    The bin of x is the number of edges below x, which equals
    ``bins * (number of smaller values) div n``.
    """
    counts, values = values_at_ranks(df, lambda n: edge_ranks(n, bins), columns)
    return {c: [values[c][r] for r in edge_ranks(counts[c], bins)] if counts[c] else [] for c in columns}


def bin_of(value: Column, edges: list) -> Column:
    """Number of edges strictly below ``value``, found by halving; equal edges count each."""
    if not edges:
        return F.lit(0)
    return _halve(value, edges, 0, len(edges))


def _halve(value: Column, edges: list, low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value > F.lit(edges[middle]), _halve(value, edges, middle + 1, high)).otherwise(
        _halve(value, edges, low, middle)
    )
