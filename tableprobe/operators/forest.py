"""A regression forest for tables whose bagged rows do not fit in memory.

Spark ML keeps one object with a weight per tree for every row of every fold and reads all of them
at each depth. Here every column is cut into bins once and columns are packed into a few cell
numbers per row; a depth of all trees of all folds is one scan that counts cells per node, and what
tasks send are sums per node and bin. Trees are grown by the largest gain of variance with rows drawn
with replacement (a Poisson weight per row and tree), as Spark ML grows them; bin edges come
from all rows, everything else from the rows of the training folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import finite, ref

BINS = 32
EDGE_RANKS = 1000
GROUP_CELLS = 8192
MAX_DEPTH = 5  # the nodes of a row are one bit in 32
ROWS_AT_ONCE = 1 << 20
# Weights of a row: four trees share one 64-bit hash, 16 bits each.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 10)]))
WEIGHT_OF = np.searchsorted(_POISSON, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Column:
    """One column in bins: numbers by edges (a value at an edge lies left of it), categories by level; the last code is a missing value."""

    name: str
    edges: list[float] = field(default_factory=list)
    levels: int = 0

    @property
    def bins(self) -> int:
        # Category codes end with "no level", which no feature stands for.
        return self.levels + 1 if self.levels else len(self.edges) + 1

    def code_of(self, value: float) -> int:
        return int(value) if self.levels else int(np.searchsorted(self.edges, value))


@dataclass
class Layout:
    """How columns share cell numbers: each group is a list of column positions."""

    columns: list[Column]
    groups: list[list[int]]

    def sizes(self, g: int) -> list[int]:
        return [self.columns[i].bins + 1 for i in self.groups[g]]

    def cells(self, g: int) -> int:
        return int(np.prod(self.sizes(g), dtype=np.int64))


@dataclass
class Trees:
    """Trees of one forest in heap order: column (-1: no split), code, and the mean of each last node."""

    fills: list[int]
    without: int | None  # the fold left out
    column: np.ndarray
    code: np.ndarray
    value: np.ndarray
    importances: np.ndarray  # per tree and feature


def numeric_columns(df: DataFrame, names: list[str], bins: int = BINS) -> list[Column]:
    """Bin edges of numbers: every value of a column that has few, else values at equal ranks (to a twentieth of a percent)."""
    if not names:
        return []
    ranks = F.lit([i / EDGE_RANKS for i in range(EDGE_RANKS + 1)])
    row = df.agg(*[F.percentile_approx(finite(ref(c)), ranks, F.lit(2 * EDGE_RANKS)).alias(f"q{i}") for i, c in enumerate(names)]).first()
    out = []
    for i, c in enumerate(names):
        values = np.array(row[f"q{i}"] or [], dtype=float)
        known = np.unique(values)
        if len(known) > bins:
            known = np.unique(np.append(values[[EDGE_RANKS * j // bins for j in range(1, bins)]], known[-1]))
        out.append(Column(c, known[:-1].tolist()))
    return out


def laid_out(columns: list[Column]) -> Layout:
    """Columns in groups of at most about ``GROUP_CELLS`` cells, the largest columns first."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for i in sorted(range(len(columns)), key=lambda i: -columns[i].bins):
        size = columns[i].bins + 1
        at = next((g for g, n in enumerate(cells) if n * size <= GROUP_CELLS), None)
        if at is None:
            groups.append([i])
            cells.append(size)
        else:
            groups[at].append(i)
            cells[at] *= size
    return Layout(columns, groups)


def with_cells(rows: DataFrame, layout: Layout) -> DataFrame:
    """``(row, fold, label, c0, …)``: one integer per group, from ``x0``, ``x1``, … in the order of the columns, NULL if missing."""
    groups, columns = len(layout.groups), layout.columns

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for i, c in enumerate(columns):
                value = b[f"x{i}"].to_numpy(zero_copy_only=False).astype(float)
                missing = np.isnan(value)
                code = np.where(missing, 0, value).astype(np.int64) if c.levels else np.searchsorted(c.edges, value)
                codes.append(np.where(missing, c.bins, code))
            out = {"row": b["row"], "fold": b["fold"], "label": b["label"]}
            for g, members in enumerate(layout.groups):
                cell = np.zeros(b.num_rows, dtype=np.int64)
                for i, size in zip(members, layout.sizes(g)):
                    cell = cell * size + codes[i]
                out[f"c{g}"] = pa.array(cell.astype(np.int32))
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(coded, ", ".join(["row long, fold int, label double", *[f"c{g} int" for g in range(groups)]]))


def bag_weights(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Poisson(1) weights ``(tree, row)`` from the row's number."""
    out = np.empty((-(-trees // 4) * 4, len(rows)), dtype=np.uint8)
    base = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    with np.errstate(over="ignore"):
        for j in range(0, trees, 4):
            z = base + np.uint64(((j + 1) * 0xD1B54A32D192ED03) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            for k in range(4):
                out[j + k] = WEIGHT_OF[(z >> np.uint64(16 * k)).astype(np.uint16)]
    return out[:trees]


def _masks(layout: Layout, forest: Trees, tree: int, depth: int) -> list[np.ndarray]:
    """Per group and cell, the set of nodes of ``depth`` that the cell's columns allow, as bits."""
    allowed = [np.full(c.bins + 1, (1 << (1 << depth)) - 1, dtype=np.uint64) for c in layout.columns]
    for level in range(depth):
        for n in range(1 << level):
            node = (1 << level) - 1 + n
            below = 1 << (depth - level - 1)  # nodes of the wanted depth under each child
            left = ((1 << below) - 1) << (2 * n * below)
            right = left << below
            c = int(forest.column[tree, node])
            if c < 0:  # all rows go left
                allowed[0] &= np.uint64(~right & (2**64 - 1))
                continue
            codes = np.arange(layout.columns[c].bins + 1)
            codes[-1] = forest.fills[c]
            goes_right = codes == forest.code[tree, node] if layout.columns[c].levels else codes > forest.code[tree, node]
            allowed[c] &= np.where(goes_right, np.uint64(~left & (2**64 - 1)), np.uint64(~right & (2**64 - 1)))
    out = []
    for members in layout.groups:
        table = allowed[members[0]]
        for i in members[1:]:
            table = (table[:, None] & allowed[i][None, :]).ravel()
        out.append(table.astype(np.uint32))
    return out


_BIT = np.zeros((1 << 15) + 1, dtype=np.int64)
_BIT[1 << np.arange(16)] = np.arange(16)


def _node_of(bits: np.ndarray, depth: int) -> np.ndarray:
    """The position of the one bit that is set."""
    return _BIT.take(bits) if depth < 5 else (np.frexp(bits.astype(float))[1] - 1).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _counted(layout: Layout, forests: list[Trees], trees: int, depth: int, scale: tuple[float, float], seed: int, batches) -> np.ndarray | None:
    """Weights and weighted labels per forest, tree, node and bin, over the rows of one task."""
    nodes, groups = 1 << depth, range(len(layout.groups))
    starts = np.cumsum([0] + [c.bins + 1 for c in layout.columns])
    out = None
    masks: dict = {}
    starts_of = [_BIT * layout.cells(g) for g in groups]  # where the cells of a node begin

    def per_bin(g: int, at: np.ndarray, values: np.ndarray, parts: int) -> list[np.ndarray]:
        members, sizes = layout.groups[g], layout.sizes(g)
        found = np.bincount(at, values, parts * layout.cells(g)).reshape(parts, *sizes)
        return [found.sum(axis=tuple(1 + x for x in range(len(members)) if x != j)) for j in range(len(members))]

    for table in _batches(batches):
        if out is None:
            out = np.zeros((len(forests), trees, nodes, starts[-1], 2))
        order = np.argsort(table["fold"].to_numpy(), kind="stable")
        fold = table["fold"].to_numpy()[order]
        y = (table["label"].to_numpy()[order] - scale[0]) / scale[1]
        cells = [table[f"c{g}"].to_numpy()[order].astype(np.int64) for g in groups]
        weights = bag_weights(table["row"].to_numpy()[order], trees, seed)
        last = int(fold[-1]) + 1
        for t in range(trees):
            some = np.flatnonzero(weights[t])
            w = weights[t].take(some).astype(float)
            wy, own = w * y.take(some), [c.take(some) for c in cells]
            bounds = np.searchsorted(fold.take(some), np.arange(last + 1))
            if not depth:  # all forests have the same node here: its sums per fold tell those without a fold
                folds = np.repeat(np.arange(last), np.diff(bounds))
                for g in groups:
                    at = folds * layout.cells(g) + own[g]
                    for k, values in enumerate((w, wy)):
                        for i, found in zip(layout.groups[g], per_bin(g, at, values, last)):
                            for f, forest in enumerate(forests):
                                inside = [x for x in range(last) if x != forest.without]
                                out[f, t, 0, starts[i]:starts[i + 1], k] += found[inside].sum(axis=0)
                continue
            for f, forest in enumerate(forests):
                here, sums = w, wy
                if forest.without is not None and forest.without < last:
                    left_out = slice(bounds[forest.without], bounds[forest.without + 1])
                    here, sums = w.copy(), wy.copy()
                    here[left_out] = sums[left_out] = 0.0
                if (f, t) not in masks:
                    masks[f, t] = [m.astype(np.uint16) for m in _masks(layout, forest, t, depth)]
                bits = masks[f, t][0].take(own[0])
                for mask, c in zip(masks[f, t][1:], own[1:]):
                    bits &= mask.take(c)
                for g in groups:
                    at = starts_of[g].take(bits)
                    at += own[g]
                    for k, values in enumerate((here, sums)):
                        for i, found in zip(layout.groups[g], per_bin(g, at, values, nodes)):
                            out[f, t, :, starts[i]:starts[i + 1], k] += found
    return out


def _split(layout: Layout, forest: Trees, sums: np.ndarray, depth: int, first_feature: list[int]) -> None:
    """Choose the split of every node of ``depth`` from its sums per bin, all trees at once."""
    trees, nodes = sums.shape[:2]
    starts = np.cumsum([0] + [c.bins + 1 for c in layout.columns])
    best = np.zeros((trees, nodes))
    column, code, feature = (np.full((trees, nodes), -1) for _ in range(3))
    whole = sums[:, :, : starts[1]].sum(axis=2)
    left_value = right_value = whole[..., 1] / np.maximum(whole[..., 0], 1e-300)
    for i, c in enumerate(layout.columns):
        part = sums[:, :, starts[i]:starts[i + 1]].copy()
        part[:, :, forest.fills[i]] += part[:, :, -1]
        right = part[:, :, : c.levels] if c.levels else whole[:, :, None] - part[:, :, :-2].cumsum(axis=2)
        if not right.shape[2]:
            continue
        left = whole[:, :, None] - right
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - (whole[..., 1] ** 2 / whole[..., 0])[:, :, None]
            means = left[..., 1] / left[..., 0], right[..., 1] / right[..., 0]
        gain = np.where((np.rint(left[..., 0]) >= 1) & (np.rint(right[..., 0]) >= 1), gain, 0.0)
        at = gain.argmax(axis=2)
        top = np.take_along_axis(gain, at[:, :, None], 2)[:, :, 0]
        better = top > np.maximum(best, 1e-9)  # labels have a spread of 1 here
        best = np.where(better, top, best)
        column, code = np.where(better, i, column), np.where(better, at, code)
        feature = np.where(better, first_feature[i] + (at if c.levels else 0), feature)
        left_value, right_value = (np.where(better, np.take_along_axis(m, at[:, :, None], 2)[:, :, 0], v) for m, v in zip(means, (left_value, right_value)))
    first = nodes - 1
    forest.column[:, first:first + nodes], forest.code[:, first:first + nodes] = column, code
    for t, n in zip(*np.nonzero(column >= 0)):
        forest.importances[t, feature[t, n]] += best[t, n]
    if 2 * nodes == forest.value.shape[1]:
        forest.value[:, 0::2], forest.value[:, 1::2] = left_value, right_value


def grow(
    rows: DataFrame, layout: Layout, fills: dict[int | None, list[int]], trees: int, depth: int, seed: int
) -> dict[int | None, Trees]:
    """One forest per entry of ``fills`` (the fold left out, None: no fold): ``rows`` have row, fold, label and cells."""
    if depth > MAX_DEPTH:
        raise ValueError(f"trees of more than {MAX_DEPTH} levels are not built")
    features = [c.levels or 1 for c in layout.columns]
    first_feature = np.cumsum([0, *features]).tolist()
    mean, spread = rows.agg(F.avg("label"), F.stddev_pop("label")).first()
    scale = (mean or 0.0, spread or 1.0)
    shape = (trees, (1 << depth) - 1)
    forests = [
        Trees(f, without, np.full(shape, -1), np.full(shape, -1), np.zeros((trees, 1 << depth)), np.zeros((trees, first_feature[-1])))
        for without, f in fills.items()
    ]
    context = rows.sparkSession.sparkContext
    for level in range(depth if layout.columns else 0):
        shared = context.broadcast(forests)
        sums = _level_sums(rows, layout, shared, len(forests), trees, level, scale, seed)
        shared.unpersist()
        for f, forest in enumerate(forests):
            _split(layout, forest, sums[f], level, first_feature)
    for forest in forests:
        forest.value = scale[0] + scale[1] * forest.value
    return dict(zip(fills, forests))


def _level_sums(rows, layout, shared, n_forests, trees, level, scale, seed) -> np.ndarray:
    """Tasks send one row per forest and tree; these are added up apart from one another."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _counted(layout, shared.value, trees, level, scale, seed, batches)
        if found is not None:
            ids = [f * trees + t for f in range(n_forests) for t in range(trees)]
            yield pa.RecordBatch.from_pydict({"tree": pa.array(ids, pa.int32()), "sums": pa.array([found[i // trees, i % trees].tobytes() for i in ids], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in table["sums"])
        return pa.table({"tree": table["tree"][:1].combine_chunks(), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "tree int, sums binary"
    width = sum(c.bins + 1 for c in layout.columns)
    out = np.zeros((n_forests, trees, 1 << level, width, 2))
    for r in rows.mapInArrow(counted, kind).groupBy("tree").applyInArrow(added, kind).collect():
        out[r["tree"] // trees, r["tree"] % trees] = np.frombuffer(r["sums"]).reshape(1 << level, width, 2)
    return out


def predictions(rows: DataFrame, layout: Layout, forests: dict[int | None, Trees]) -> DataFrame:
    """``(fold, label, prediction)``: every row by the forest that did not see its fold."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict = {}
        for table in _batches(batches):
            label, fold = table["label"].to_numpy(), table["fold"].to_numpy()
            cells = [table[f"c{g}"].to_numpy() for g in range(len(layout.groups))]
            out = np.empty(len(label))
            for f in np.unique(fold):
                forest, here = shared.value[int(f)], np.flatnonzero(fold == f)
                own, total = [c[here] for c in cells], np.zeros(len(here))
                trees, last = forest.value.shape
                depth = last.bit_length() - 1
                for t in range(trees):
                    if (f, t) not in masks:
                        masks[f, t] = _masks(layout, forest, t, depth)
                    bits = np.full(len(here), 1, dtype=np.uint32) if not own else masks[f, t][0][own[0]]
                    for table_, c in zip(masks[f, t][1:], own[1:]):
                        bits &= table_[c]
                    total += forest.value[t][_node_of(bits, depth)]
                out[here] = total / trees
            yield pa.RecordBatch.from_pydict({"fold": pa.array(fold, pa.int32()), "label": label, "prediction": out})

    return rows.select("fold", "label", *[f"c{g}" for g in range(len(layout.groups))]).mapInArrow(predicted, "fold int, label double, prediction double")


def importances(forest: Trees) -> np.ndarray:
    """Gains per feature, each tree counting the same, adding up to 1."""
    per_tree = forest.importances / np.maximum(forest.importances.sum(axis=1, keepdims=True), 1e-300)
    total = per_tree.sum(axis=0)
    return total / total.sum() if total.sum() > 0 else total
