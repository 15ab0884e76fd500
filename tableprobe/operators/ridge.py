"""Ridge regressions of all folds from one scan that adds up products of columns.

Tasks keep the sums of each fold over standardised numbers, marks of missing values, levels and the
label. Fill values and scales are linear in these columns, so what a set of training folds
would give is worked out from their sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Design:
    """The columns that are multiplied: 1, numbers, levels, marks of missing values, label."""

    centre: list[float]  # of the numbers, then of the label
    spread: list[float]
    levels: list[int]  # per category
    gaps: list[int]  # positions of columns with missing values, numbers first

    def matrix(self, table: pa.Table) -> np.ndarray:
        rows, n = table.num_rows, len(self.centre) - 1
        out = np.zeros((rows, self.width))
        out[:, 0] = 1.0
        at, marks = 1 + n, 1 + n + sum(self.levels)
        for i in range(n + len(self.levels)):
            values = table[f"x{i}"].to_numpy().astype(float)
            missing = np.isnan(values)
            if i < n:
                out[:, 1 + i] = np.where(missing, 0.0, (values - self.centre[i]) / self.spread[i])
            else:
                here = np.flatnonzero(~missing & (values < self.levels[i - n]))
                out[here, at + values[here].astype(int)] = 1.0
                at += self.levels[i - n]
            if i in self.gaps:
                out[:, marks + self.gaps.index(i)] = missing
        out[:, -1] = (table["label"].to_numpy() - self.centre[-1]) / self.spread[-1]
        return out

    @property
    def width(self) -> int:
        return 1 + len(self.centre) + sum(self.levels) + len(self.gaps)

    def features(self, fills: list[float]) -> np.ndarray:
        """Features as sums of the columns: one row per number and level, with missing values filled."""
        n, wide = len(self.centre) - 1, sum(self.levels)
        out = np.zeros((n + wide, self.width - 1))
        out[:, 1:1 + n + wide] = np.eye(n + wide)
        first = n + np.cumsum([0, *self.levels])
        for g, i in enumerate(self.gaps):
            if i < n:
                out[i, 1 + n + wide + g] = (fills[i] - self.centre[i]) / self.spread[i]
            elif fills[i] < self.levels[i - n]:
                out[first[i - n] + int(fills[i]), 1 + n + wide + g] = 1.0
        return out


def sums_of_folds(rows: DataFrame, design: Design, folds: int) -> np.ndarray:
    """``(fold, column, column)`` over ``rows`` with fold, label and ``x0``, ``x1``, …; NULL is missing."""
    width = design.width

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((folds, width, width))
        for b in batches:
            fold, x = b["fold"].to_numpy(), design.matrix(pa.Table.from_batches([b]))
            for f in range(folds):
                part = x[fold == f]
                out[f] += part.T @ part
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(folds), pa.int32()), "sums": pa.array([s.tobytes() for s in out], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table["sums"])
        return pa.table({"part": table["part"][:1].combine_chunks(), "sums": pa.array([total.tobytes()], pa.binary())})

    kind, out = "part int, sums binary", np.zeros((folds, width, width))
    for r in rows.mapInArrow(added, kind).groupBy("part").applyInArrow(merged, kind).collect():
        out[r["part"]] = np.frombuffer(r["sums"]).reshape(width, width)
    return out


def solve(design: Design, sums: np.ndarray, scaled_by: np.ndarray, fills: list[float], alpha: float) -> np.ndarray:
    """Weights of the columns (without the label) that predict the label.

    ``sums`` are those of the training rows, ``scaled_by`` of the rows that means and deviations are learned on.
    """
    features, n = design.features(fills), len(design.centre) - 1

    def moments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = max(s[0, 0], 1.0)
        mean = features @ s[:-1, 0] / rows
        return mean, features @ s[:-1, :-1] @ features.T - rows * np.outer(mean, mean)

    spread = np.ones(len(features))
    deviation = np.sqrt(np.maximum(np.diag(moments(scaled_by)[1])[:n], 0.0) / max(scaled_by[0, 0], 1.0))
    spread[:n] = np.where(deviation > 1e-9, deviation, 1.0)  # the columns have a deviation of about 1, or are constant
    mean, products = moments(sums)
    label = sums[-1, 0] / max(sums[0, 0], 1.0)
    with_label = (features @ sums[:-1, -1] - sums[0, 0] * mean * label) / spread
    weights = np.linalg.solve(products / np.outer(spread, spread) + alpha * np.eye(len(features)), with_label) / spread
    out = weights @ features
    out[0] += label - weights @ mean
    return out


def predictions(rows: DataFrame, design: Design, weights: dict[int, np.ndarray]) -> DataFrame:
    """``(fold, label, prediction)``, every row by the weights learned without its fold."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.stack([weights[f] for f in sorted(weights)])
        for b in batches:
            fold = b["fold"].to_numpy()
            value = np.einsum("ij,ij->i", design.matrix(pa.Table.from_batches([b]))[:, :-1], every[fold])
            yield pa.RecordBatch.from_pydict({"fold": pa.array(fold, pa.int32()), "label": b["label"], "prediction": design.centre[-1] + design.spread[-1] * value})

    return rows.mapInArrow(predicted, "fold int, label double, prediction double")


def design_of(rows: DataFrame, numbers: int, levels: list[int]) -> tuple[Design, int]:
    """Centres, spreads and gaps from one scan, and the number of rows."""
    columns = [f"x{i}" for i in range(numbers)]
    found = rows.agg(
        F.count(F.lit(1)),
        *[F.count(f"x{i}") for i in range(numbers + len(levels))],
        *[f(c) for c in [*columns, "label"] for f in (F.avg, F.stddev_pop)],
    ).first()
    n, present, stats = found[0], found[1:1 + numbers + len(levels)], found[1 + numbers + len(levels):]
    centre, spread = [v or 0.0 for v in stats[0::2]], [v or 1.0 for v in stats[1::2]]
    return Design(centre, spread, levels, [i for i, k in enumerate(present) if k < n]), n
