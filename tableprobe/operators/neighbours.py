"""Nearest vectors of a catalog for many query vectors, exact.

Neither side is crossed with the other row by row. A catalog whose size was checked is
broadcast as one matrix; a larger one is cut into blocks of bounded size, the queries are
sent to every block in bounded groups and each pair of blocks keeps only its own best k,
which are then merged per query. Inside a block, products in single precision (for manhattan, sums of small whole
numbers) give bounds that most pairs cannot meet; the others are measured in double precision. Where neighbours must be of the query's group, both sides are
split by group before they are cut, so no distance between groups is computed. Ids are whole
numbers or, if either side has another type, texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import ref
from tableprobe.functions.vectors import check_metric

TOP_K = 5
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
CATALOG_BLOCK_ROWS = 65_536
QUERY_BLOCK_ROWS = 32_768
QUERY_CHUNK = 512
# Catalog rows compared at once: few at first, so that later ones meet a good bound.
FIRST_TILE, LAST_TILE = 64, 8192
MANHATTAN_TILE = (64, 1024)
PAIRS_AT_ONCE = 65_536
# Single precision says nothing about numbers beyond this.
LARGEST = 1e15
TIE = 2e-12


def _distances(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The distance of each pair of rows; sums in another order must not decide a tie."""
    if metric == "cosine":
        lengths = np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.round(1 - np.einsum("ij,ij->i", q, c) / lengths, 12)
    gap = c - q
    return np.round(np.abs(gap).sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1)), 12)


class _Bounds:
    """Lower bounds of the distances from a chunk of queries to tiles of a catalog, in small numbers.

    ``near(tile, limit)`` marks every pair whose distance may be at most the limit of its query. Rounding
    errors are bounded, so no such pair is missed; pairs that are marked are measured in double precision.
    """

    def __init__(self, metric: str, c: np.ndarray):
        self.metric, self.n = metric, c.shape[1]
        self.error = (self.n + 8) * 1.2e-7
        self.usable = bool(np.abs(c).max(initial=0.0) < LARGEST)
        if not self.usable:
            return
        if metric == "manhattan":
            # Whole numbers whose sums are exact; a value is off by half a step at most.
            self.kind, most = (np.int16, 32_767) if self.n <= 128 else (np.float32, 2**24)
            self.top = most // max(self.n, 1)
            self.low = c.min(initial=0.0)
            self.step = (c.max(initial=0.0) - self.low) / max(self.top, 1) or 1.0
            self.usable = self.top >= 1
            whole = self._whole(c)
            self.columns, self.halves = np.ascontiguousarray(whole.T), (whole.sum(axis=1, dtype=np.int64) // 2).astype(self.kind)
            return
        lengths = np.linalg.norm(c, axis=1)
        if metric == "cosine":
            self.usable = bool((lengths > 1 / LARGEST).all())
            self.rows = (c / np.maximum(lengths, 1e-300)[:, None]).astype(np.float32)
            return
        self.centre = c.mean(axis=0) if len(c) else np.zeros(self.n)
        moved = c - self.centre
        squares = (moved * moved).sum(axis=1)
        self.scale = float(np.sqrt(squares.max(initial=0.0))) or 1.0
        self.rows = np.column_stack([2 * moved / self.scale, -squares / self.scale**2]).astype(np.float32)

    def _whole(self, x: np.ndarray) -> np.ndarray:
        return np.rint(np.clip((x - self.low) / self.step, 0, self.top)).astype(self.kind)

    def take(self, q: np.ndarray) -> bool:
        """The queries that follow; False if bounds say nothing about them."""
        if not self.usable or np.abs(q).max(initial=0.0) >= LARGEST:
            return False
        if self.metric == "manhattan":
            self.q = self._whole(q)
            self.q_sums = self.q.sum(axis=1, dtype=np.int64)
            return True
        if self.metric == "cosine":
            lengths = np.linalg.norm(q, axis=1)
            self.q = (q / np.maximum(lengths, 1e-300)[:, None]).astype(np.float32)
            return bool((lengths > 1 / LARGEST).all())
        moved = (q - self.centre) / self.scale
        self.squares = (moved * moved).sum(axis=1)
        self.q = np.column_stack([moved, np.ones(len(q))]).astype(np.float32)
        return bool(self.squares.max(initial=0.0) < LARGEST)

    def near(self, start: int, stop: int, limit: np.ndarray) -> np.ndarray:
        if self.metric == "manhattan":
            return self._near_manhattan(start, stop, limit)
        if self.metric == "cosine":
            least = 1 - limit - self.error - TIE
        else:
            error = self.error * (np.sqrt(self.squares) + 1) ** 2
            least = self.squares - ((limit + TIE) / self.scale) ** 2 * (1 + 1e-12) - error
        least = np.nextafter(np.maximum(least, -3e38).astype(np.float32), np.float32(-np.inf))
        return self.q @ self.rows[start:stop].T >= least[:, None]

    def _near_manhattan(self, start: int, stop: int, limit: np.ndarray) -> np.ndarray:
        """|a - b| = a + b - 2 min(a, b); a query outside the catalog's range is moved to its end, which is no farther."""
        out = np.empty((len(self.q), stop - start), dtype=bool)
        rows, width = MANHATTAN_TILE
        most = np.floor(np.minimum((limit + TIE) / self.step * (1 + 1e-12) + 1.001 * self.n, 2.0**40)).astype(np.int64)
        # Halves are rounded down; below the clip the sum with the catalog's half is negative anyway.
        least = np.maximum((self.q_sums - most) // 2, -(self.top * self.n) // 2 - 1).astype(self.kind)
        for left in range(start, stop, width):
            right = min(left + width, stop)
            for top in range(0, len(self.q), rows):
                q = self.q[top:top + rows]
                shared, each = np.empty((len(q), right - left), dtype=self.kind), np.empty((len(q), right - left), dtype=self.kind)
                shared[:] = -self.halves[left:right]
                for j in range(self.n):
                    np.minimum(q[:, j, None], self.columns[j, left:right], out=each)
                    shared += each
                out[top:top + rows, left - start:right - start] = shared >= least[top:top + rows, None]
        return out


class _Catalog:
    """Catalog rows in the order of their ids, ready for many queries."""

    def __init__(self, metric: str, k: int, ids: np.ndarray, rows: np.ndarray):
        self.metric, self.k = metric, k
        able = _measurable(metric, rows)
        order = np.argsort(ids[able], kind="stable")
        self.ids, self.rows = ids[able][order], rows[able][order]
        if len(self.ids) > k and self.rows.shape[1] and len(np.unique(self.ids)) == len(self.ids):
            # Of equal vectors only the first k + 1 can be among the k nearest others.
            _, kinds = np.unique(np.ascontiguousarray(self.rows).view(np.dtype((np.void, self.rows.shape[1] * 8))).ravel(), return_inverse=True)
            sorted_ = np.argsort(kinds, kind="stable")
            first = np.flatnonzero(np.diff(kinds[sorted_], prepend=-1))
            place = np.arange(len(kinds)) - np.repeat(first, np.diff(np.append(first, len(kinds))))
            kept = np.sort(sorted_[place <= k])
            self.ids, self.rows = self.ids[kept], self.rows[kept]
        self.bounds = _Bounds(metric, self.rows) if len(self.ids) else None

    def search(self, ids: np.ndarray, rows: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, catalog positions and distances of the k nearest; ties by catalog id."""
        found = []
        able = np.flatnonzero(_measurable(self.metric, rows)) if len(self.ids) else []
        for start in range(0, len(able), QUERY_CHUNK):
            part = able[start:start + QUERY_CHUNK]
            at, c, d = self._chunk(ids[part], rows[part], skip_self)
            found.append((part[at], c, d))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, np.zeros(0))

    def _chunk(self, ids, q, skip_self):
        bounded = self.bounds.take(q)
        at, near, d = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        limit = np.full(len(q), np.inf)
        start, width = 0, FIRST_TILE
        while start < len(self.ids):
            stop = min(start + width, len(self.ids))
            marks = self.bounds.near(start, stop, limit) if bounded and start else np.ones((len(q), stop - start), dtype=bool)
            spots = np.flatnonzero(marks)
            new_at, new = spots // (stop - start), spots % (stop - start) + start
            if skip_self:
                other = ids[new_at] != self.ids[new]
                new_at, new = new_at[other], new[other]
            if len(new):
                pieces = range(0, len(new), PAIRS_AT_ONCE)
                new_d = np.concatenate([_distances(self.metric, q[new_at[i:i + PAIRS_AT_ONCE]], self.rows[new[i:i + PAIRS_AT_ONCE]]) for i in pieces])
                good = np.isfinite(new_d)
                at, near, d = np.append(at, new_at[good]), np.append(near, new[good]), np.append(d, new_d[good])
                order = np.lexsort((near, d, at))
                at, near, d = at[order], near[order], d[order]
                first = np.searchsorted(at, at)
                kept = np.arange(len(at)) - first < self.k
                at, near, d = at[kept], near[kept], d[kept]
                last = np.searchsorted(at, np.arange(len(q)), side="right") - 1
                full = np.bincount(at, minlength=len(q)) == self.k
                limit[full] = d[last[full]]
            start, width = stop, min(4 * width, LAST_TILE)
        return at, near, d


def _measurable(metric: str, rows: np.ndarray) -> np.ndarray:
    """Rows that have a distance at all: no missing or infinite values and, for the cosine, a length."""
    finite = np.isfinite(rows).all(axis=1)
    return finite & (rows != 0).any(axis=1) if metric == "cosine" else finite


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if not len(vectors):
        return np.empty((0, 0))
    lengths = pc.list_value_length(vectors)
    if pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError("all vectors must have the same length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _result(q_ids: np.ndarray, c_ids: np.ndarray, d: np.ndarray, kind: str) -> dict:
    of = pa.int64() if kind == "long" else pa.string()
    return {"query_id": pa.array(q_ids, of), "catalog_id": pa.array(c_ids, of), "distance": pa.array(d, pa.float64())}


def nearest(
    queries: DataFrame,
    catalog: DataFrame,
    *,
    metric: str = "cosine",
    k: int = TOP_K,
    group: str | None = None,
    skip_self: bool = False,
    query_id: str = "id",
    catalog_id: str = "id",
    vector: str = "vector",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(query_id, rank, catalog_id, distance)``: the ``k`` nearest, ascending.

    ``group`` restricts the neighbours of a query to catalog rows of the same value (the
    task filter); without it the whole catalog is searched. Equal distances go by id.
    """
    check_metric(metric)
    kinds = [queries.schema[query_id].dataType, catalog.schema[catalog_id].dataType]
    kind = "long" if all(isinstance(k, T.IntegralType) for k in kinds) else "string"
    label = ref(group).cast("string") if group else F.lit("")
    # Single precision is moved as it is and measured in double.
    floats = all(x.schema[vector].dataType == T.ArrayType(T.FloatType(), x.schema[vector].dataType.containsNull) for x in (queries, catalog))
    numbers = "array<float>" if floats else "array<double>"
    q = queries.select(ref(query_id).cast(kind).alias("id"), label.alias("g"), ref(vector).cast(numbers).alias("v"))
    c = catalog.select(ref(catalog_id).cast(kind).alias("id"), label.alias("g"), ref(vector).cast(numbers).alias("v"))
    c = c.where(F.col("v").isNotNull())
    q = q.where(F.col("v").isNotNull())
    out = f"query_id {kind}, catalog_id {kind}, distance double"
    size = c.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("length")).first()
    if size["n"] * (size["length"] * 8 + 64) <= broadcast_bytes:
        found = _against_broadcast(q, c, metric, k, skip_self, kind, out)
    else:
        found = _against_blocks(q, c, metric, k, skip_self, kind, out, BLOCK_BYTES // (8 * max(size["length"], 1)))
    window = Window.partitionBy("query_id").orderBy("distance", "catalog_id")
    return (
        found.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "catalog_id", "distance")
    )


def _against_broadcast(q, c, metric, k, skip_self, kind, out) -> DataFrame:
    local = c.toArrow()  # size checked by the caller
    shared = c.sparkSession.sparkContext.broadcast((_ids(local["id"]), np.array(local["g"].to_pylist(), dtype=object), _matrix(local["v"])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids, all_groups, matrix = shared.value
        catalogs: dict = {}
        for b in batches:
            if not b.num_rows or not len(all_ids):
                continue
            ids, rows, groups = _ids(b["id"]), _matrix(b["v"]), np.array(b["g"].to_pylist(), dtype=object)
            for g in set(groups):
                if g not in catalogs:
                    same = all_groups == g
                    catalogs[g] = _Catalog(metric, k, all_ids[same], matrix[same])
                here = groups == g
                own = ids[here]
                at, near, d = catalogs[g].search(own, rows[here], skip_self)
                yield pa.RecordBatch.from_pydict(_result(own[at], catalogs[g].ids[near], d, kind))

    return q.mapInArrow(search, out)


def _block_counts(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Per group, into how many blocks of at most about ``size`` rows it is cut."""
    return rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def _against_blocks(q, c, metric, k, skip_self, kind, out, most) -> DataFrame:
    in_c, in_q = (max(1, min(rows, most)) for rows in (CATALOG_BLOCK_ROWS, QUERY_BLOCK_ROWS))
    counts = _block_counts(c, in_c, "c_blocks").join(_block_counts(q, in_q, "q_blocks"), "g")

    def placed(rows: DataFrame, mine: str, others: str, at: str, meets: str) -> DataFrame:
        """Rows with their block, once for every block of the other side in their group."""
        cut = rows.join(counts, "g").withColumn(at, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
        return cut.withColumn(meets, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select("g", "qb", "cb", "id", "v")

    catalog = placed(c, "c_blocks", "q_blocks", "cb", "qb")
    queries = placed(q, "q_blocks", "c_blocks", "qb", "cb")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = _ids(left["id"])
        if not left.num_rows or not right.num_rows:
            return pa.table(_result(ids[:0], ids[:0], np.zeros(0), kind))
        block = _Catalog(metric, k, _ids(right["id"]), _matrix(right["v"]))
        at, near, d = block.search(ids, _matrix(left["v"]), skip_self)
        return pa.table(_result(ids[at], block.ids[near], d, kind))

    return queries.groupBy("g", "qb", "cb").cogroup(catalog.groupBy("g", "qb", "cb")).applyInArrow(search, out)
