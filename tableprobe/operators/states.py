"""Statistics of numbers as states: tasks build them batch by batch, and states merge.

One scan of a table feeds any number of collectors. A collector sees every batch as a matrix with NaN for a
missing value and leaves small rows: states of its parts, which are merged pairwise in a tree of tasks, or
counts, which Spark adds up. What is shuffled depends on the number of columns and tasks, never on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import finite, ref

FAN_IN = 32
TILE = 32
DIGIT = 12  # bits of a value's rank that one pass tells apart
HELD_CELLS = 1 << 20
ROWS = "kind string, part long, cell long, n long, low double, high double, state binary"
SCHEMA = pa.schema([("kind", pa.string()), *[(c, pa.int64()) for c in ("part", "cell", "n")], *[(c, pa.float64()) for c in ("low", "high")], ("state", pa.binary())])


def rows_of(kind: str, **columns) -> pa.RecordBatch:
    """Output rows of a collector; columns that are not given are NULL."""
    n = len(next(iter(columns.values())))
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


class Moments:
    """Count, mean, second to fourth central moment sums, minimum, maximum and plain sum of every column.

    The plain sum is added up row by row, as SQL engines do, so that the mean is theirs to the last bit.
    """

    kind = "moments"
    fields = 8

    def __init__(self):
        self.state: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        present = ~np.isnan(x)
        n = present.sum(axis=0).astype(float)
        low, high = np.where(present, x, np.inf).min(axis=0), np.where(present, x, -np.inf).max(axis=0)
        mean = np.where(present, x, 0.0).sum(axis=0) / np.maximum(n, 1)
        mean = np.where(low == high, low, mean)  # a constant has no deviation at all
        gap = np.where(present, x - np.where(n > 0, mean, 0.0), 0.0)
        left = gap.sum(axis=0) / np.maximum(n, 1)
        mean, gap = mean + left, np.where(present, gap - left, 0.0)
        square = gap * gap
        before = np.zeros(len(n)) if self.state is None else self.state[7]
        total = np.cumsum(np.vstack([before, np.where(present, x, 0.0)]), axis=0)[-1]
        sums = [square.sum(axis=0), (square * gap).sum(axis=0), (square * square).sum(axis=0)]
        now = np.stack([n, np.where(n > 0, mean, 0.0), *sums, low, high, total - before])
        self.state = now if self.state is None else self.merge(self.state, now)
        self.state[7] = total

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = a[0], b[0]
        n = np.maximum(na + nb, 1)
        d = np.where((na > 0) & (nb > 0), b[1] - a[1], 0.0)
        mean = np.where(na == 0, b[1], np.where(nb == 0, a[1], a[1] + d * nb / n))
        m2 = a[2] + b[2] + d * d * na * nb / n
        m3 = a[3] + b[3] + d**3 * na * nb * (na - nb) / n**2 + 3 * d * (na * b[2] - nb * a[2]) / n
        m4 = a[4] + b[4] + d**4 * na * nb * (na * na - na * nb + nb * nb) / n**3
        m4 = m4 + 6 * d * d * (na * na * b[2] + nb * nb * a[2]) / n**2 + 4 * d * (na * b[3] - nb * a[3]) / n
        return np.stack([na + nb, mean, m2, m3, m4, np.minimum(a[5], b[5]), np.maximum(a[6], b[6]), a[7] + b[7]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.state is not None:
            yield rows_of(self.kind, part=[0], state=[self.state.tobytes()])

    def more(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def tiles(columns: int) -> list[tuple[slice, slice]]:
    """Blocks of pairs of columns: the rows of a tile come before or with its columns."""
    cuts = [slice(k, min(k + TILE, columns)) for k in range(0, columns, TILE)]
    return [(a, b) for i, a in enumerate(cuts) for b in cuts[i:]]


class CoMoments:
    """Of every pair of columns, over the rows where both are present: count, means, central sums, extremes.

    Held as matrices [i, j]: the number of shared rows, the sum of products, and of column i over the rows
    that j has: mean, sum of squares, minimum and maximum. Output and merging go by tile, with both halves.
    """

    kind = "comoments"

    def __init__(self, columns: int | None = None):
        self.columns = columns  # only so many columns from the first on
        self.state: dict[str, np.ndarray] | None = None

    def add(self, x: np.ndarray) -> None:
        x = x[:, : self.columns]
        present = ~np.isnan(x)
        low, high = np.where(present, x, np.inf).min(axis=0), np.where(present, x, -np.inf).max(axis=0)
        m = present.astype(float)
        count = m.sum(axis=0)
        shift = np.where(low == high, low, np.where(present, x, 0.0).sum(axis=0) / np.maximum(count, 1))
        shift = np.where(count > 0, shift, 0.0)
        gap = np.where(present, x - shift, 0.0)
        n, sums = m.T @ m, gap.T @ m
        mean = sums / np.maximum(n, 1)
        lows, highs = (np.repeat(v[:, None], x.shape[1], axis=1) for v in (low, high))
        for j in np.flatnonzero(count < len(x)):
            with_j = x[present[:, j]]
            if len(with_j):
                lows[:, j], highs[:, j] = np.fmin.reduce(with_j, axis=0), np.fmax.reduce(with_j, axis=0)
        lows, highs = np.where(n > 0, lows, np.inf), np.where(n > 0, highs, -np.inf)
        now = {
            "n": n,
            "product": gap.T @ gap - sums * mean.T,
            "mean": mean + shift[:, None],
            "square": np.maximum((gap * gap).T @ m - sums * mean, 0.0),
            "low": lows,
            "high": highs,
        }
        if self.state is None:
            self.state = now
        else:
            a, b = ([s["n"], s["product"], *[v for k in SIDED for v in (s[k], s[k].T)]] for s in (self.state, now))
            merged = self.merge(np.stack(a), np.stack(b))
            self.state = dict(zip(["n", "product", *SIDED], [merged[0], merged[1], *merged[2::2]]))

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """States of one tile: n, product, and mean, square, low and high of the row's and of the column's column."""
        na, nb = a[0], b[0]
        n = np.maximum(na + nb, 1)
        out = np.empty_like(a)
        out[0] = na + nb
        both = na * nb / n
        gaps = [np.where(both > 0, b[k] - a[k], 0.0) for k in (2, 3)]
        out[1] = a[1] + b[1] + gaps[0] * gaps[1] * both
        for k in (0, 1):
            out[2 + k] = np.where(na == 0, b[2 + k], np.where(nb == 0, a[2 + k], a[2 + k] + gaps[k] * nb / n))
            out[4 + k] = a[4 + k] + b[4 + k] + gaps[k] ** 2 * both
            out[6 + k], out[8 + k] = np.minimum(a[6 + k], b[6 + k]), np.maximum(a[8 + k], b[8 + k])
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.state is None:
            return
        s = self.state
        for k, (i, j) in enumerate(tiles(len(s["n"]))):
            both = [s["n"][i, j], s["product"][i, j], *[v for name in SIDED for v in (s[name][i, j], s[name][j, i].T)]]
            yield rows_of(self.kind, part=[k], state=[np.stack(both).tobytes()])

    def more(self) -> Iterator[pa.RecordBatch]:
        yield from ()


SIDED = ("mean", "square", "low", "high")


class Few:
    """The distinct values of columns that have at most ``limit`` of them; of others one more."""

    kind = "few"

    def __init__(self, columns: int, limit: int):
        self.limit = limit
        self.state = np.full((columns, limit + 1), np.nan)

    def add(self, x: np.ndarray) -> None:
        for i in np.flatnonzero(np.isnan(self.state[:, -1])):
            self._take(self.state[i], x[:, i] + 0.0)

    @staticmethod
    def _take(held: np.ndarray, values: np.ndarray) -> None:
        found = np.unique(np.concatenate([held, values]))
        found = found[~np.isnan(found)][: len(held)]
        held[: len(found)] = found

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a.copy()
        for i in np.flatnonzero(np.isnan(out[:, -1])):
            Few._take(out[i], b[i])
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield rows_of(self.kind, part=[0], state=[self.state.tobytes()])

    def more(self) -> Iterator[pa.RecordBatch]:
        yield from ()


class Marks:
    """Per column: values outside the fences, values with a large z-score, and counts of equal-width bins."""

    kind = "marks"

    def __init__(self, fences: list, centres: list, ranges: list, bins: int, z_limit: float):
        """Pairs per column, None where there is none: fences, (mean, std), (low, high) of the bins."""
        self.fences, self.centres, self.ranges, self.bins, self.z_limit = fences, centres, ranges, bins, z_limit
        self.state = np.zeros((len(fences), 2 + bins))

    def add(self, x: np.ndarray) -> None:
        for i, (fence, centre, range_) in enumerate(zip(self.fences, self.centres, self.ranges)):
            v = x[:, i]
            v = v[~np.isnan(v)]
            if fence:
                self.state[i, 0] += ((v < fence[0]) | (v > fence[1])).sum()
            if centre and centre[1]:
                self.state[i, 1] += (np.abs(v - centre[0]) / centre[1] > self.z_limit).sum()
            if range_ and len(v):
                at = np.floor((v - range_[0]) / (range_[1] - range_[0]) * self.bins).astype(np.int64)
                self.state[i, 2:] += np.bincount(np.minimum(at, self.bins - 1), minlength=self.bins)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield rows_of(self.kind, part=[0], state=[self.state.tobytes()])

    def more(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)


class Cells:
    """Counts of the next ``DIGIT`` bits of the values that share a prefix, with the extremes of every cell.

    ``prefixes`` has, per column, the sorted prefixes that are looked into, and ``first`` the number of the first of them.
    """

    kind = "cells"

    def __init__(self, level: int, prefixes: list[np.ndarray], first: list[int]):
        self.shift = max(0, 64 - DIGIT * (level + 1))
        self.width = min(DIGIT, 64 - DIGIT * level)
        self.above, self.prefixes, self.first = 64 - DIGIT * level, prefixes, first
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, x: np.ndarray) -> None:
        for i, (prefixes, first) in enumerate(zip(self.prefixes, self.first)):
            if not len(prefixes):
                continue
            v = x[:, i]
            v = v[~np.isnan(v)]
            bits = ordered_bits(v)
            if self.above < 64:
                prefix = bits >> np.uint64(self.above)
                at = np.minimum(np.searchsorted(prefixes, prefix), len(prefixes) - 1)
                good = prefixes[at] == prefix
                v, bits, at = v[good], bits[good], at[good]
            else:
                at = np.zeros(len(v), np.int64)
            if not len(v):
                continue
            code = ((at + first) << DIGIT) + ((bits >> np.uint64(self.shift)).astype(np.int64) & ((1 << self.width) - 1))
            self.held.append(self._counted(code, np.ones(len(v)), v, v))
            self.size += self.held[-1].shape[1]
        if self.size > HELD_CELLS:
            self._compact()

    @staticmethod
    def _counted(code: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """One column per code: code, count, least and largest value."""
        order = np.argsort(code, kind="stable")
        code = code[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return np.stack(
            [code[start].astype(float), np.add.reduceat(n[order], start), np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start)]
        )

    def _compact(self) -> None:
        code, n, low, high = np.concatenate(self.held, axis=1)
        self.held = [self._counted(code, n, low, high)]
        self.size = self.held[0].shape[1]

    def more(self) -> Iterator[pa.RecordBatch]:
        """Cells that are too many to be held go out early; Spark adds them to the later ones."""
        if self.size > HELD_CELLS // 2:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._compact()
            code, n, low, high = self.held[0]
            code = code.astype(np.int64)
            yield rows_of(self.kind, part=code >> DIGIT, cell=code & ((1 << DIGIT) - 1), n=n.astype(np.int64), low=low, high=high)
            self.held, self.size = [], 0


def scan(df: DataFrame, columns: list[str], collectors: list) -> DataFrame:
    """The rows of all collectors over the finite values of ``columns``, from one pass over ``df``."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns], axis=1)
            with np.errstate(all="ignore"):
                for c in collectors:
                    c.add(x)
            for c in collectors:
                yield from c.more()
        for c in collectors:
            yield from c.rows()

    return df.select(*[finite(ref(c)).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(collect, ROWS)


def merged(rows: DataFrame, kind: type, shape: dict[int, tuple]) -> DataFrame:
    """``part, state``: the states of a collector merged in a tree of tasks. ``shape`` is that of each part's state."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for part, raw in zip(batch.column("part").to_pylist(), batch.column("state")):
                    state = np.frombuffer(raw.as_buffer(), float).reshape(shape[part])
                    found[part] = kind.merge(found[part], state) if part in found else state
        if found:
            states = [np.ascontiguousarray(s).tobytes() for s in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(states, pa.binary())], names=["part", "state"])

    level = rows.where(F.col("kind") == kind.kind).select("part", "state")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        tasks = -(-tasks // FAN_IN)
        level = level.repartition(tasks).mapInArrow(merge, "part long, state binary")
        if tasks == 1:
            return level


def one_state(rows: DataFrame, kind: type, shape: tuple) -> np.ndarray | None:
    """The merged state of a collector with one part, a few numbers per column."""
    states = merged(rows, kind, {0: shape}).collect()
    return np.frombuffer(states[0].state, float).reshape(shape) if states else None


def few_of(rows: DataFrame, columns: list[str], limit: int) -> dict[str, list[float] | None]:
    """The distinct values of every column; None for more than ``limit``."""
    s = one_state(rows, Few, (len(columns), limit + 1))
    held = s if s is not None else np.full((len(columns), limit + 1), np.nan)
    return {c: None if not np.isnan(v[-1]) else v[~np.isnan(v)].tolist() for c, v in zip(columns, held)}


def moments_of(rows: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column: n_finite, mean, std (population), skewness, kurtosis (excess), min and max."""
    s = one_state(rows, Moments, (Moments.fields, len(columns)))
    s = np.zeros((Moments.fields, len(columns))) if s is None else s
    out = {}
    for c, (n, _, m2, m3, m4, low, high, total) in zip(columns, s.T.tolist()):
        spread = n and low < high
        out[c] = {
            "column": c,
            "n_finite": int(n),
            "mean": total / n if n else None,
            "std": (m2 / n) ** 0.5 if n else None,
            "skewness": n**0.5 * m3 / m2**1.5 if n >= 3 and spread and m2 > 0 else None,
            "kurtosis": n * m4 / m2**2 - 3 if n >= 4 and spread and m2 > 0 else None,
            "min": low if n else None,
            "max": high if n else None,
        }
    return out


def correlations_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, r)`` of every pair in column order, made where the merged tiles are."""
    every = tiles(len(columns))
    shape = {k: (10, i.stop - i.start, j.stop - j.start) for k, (i, j) in enumerate(every)}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("state")):
                s = np.frombuffer(raw.as_buffer(), float).reshape(shape[part])
                a, b = every[part]
                i, j = np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij")
                some = i < j
                with np.errstate(all="ignore"):
                    r = s[1] / (np.sqrt(s[4]) * np.sqrt(s[5]))
                defined = (s[6] < s[8]) & (s[7] < s[9]) & np.isfinite(r)
                r = pa.array(np.where(defined, r, 0.0)[some], mask=~defined[some])
                names = [pa.array([columns[k] for k in side[some]], pa.string()) for side in (i, j)]
                yield pa.RecordBatch.from_arrays([*names, r], names=["column_a", "column_b", "r"])

    return merged(rows, CoMoments, shape).mapInArrow(pairs, "column_a string, column_b string, r double")
