"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbouring
word extends. A run whose period is in [2^(k+1) - 1, 2^(k+2) - 2] holds a dyadic block, 2^k words
from a multiple of 2^k on, together with the block's copy one period later. So every dyadic block asks where
it occurs again in the windows that far behind it:

* blocks of all lengths 2^k are named by doubling; the last names give the suffix array, and the
  suffixes that start with a block are one range of it;
* a wavelet matrix over the suffix array answers range successor queries: the smallest
  occurrences in that range from a given place on;
* a window has as many starting places as its block has words, so three or more occurrences are a
  progression whose step p is the block's own period. A run with a longer period takes the stretch
  of period p around the block to the one around the occurrences. If an end of the first is inside the
  run, so is its copy, which leaves two candidates; if not, the stretches meet, and every step of the
  progression is the period of a run. One or two occurrences are candidates themselves.

Each candidate is extended to both sides by longest common extensions over the names, and kept if
it is long enough; of equal stretches the smallest period stays. Everything is exact, words are
compared by name and not by hash. Many texts are taken through numpy together, with words named per
text, so no run goes across.

Defined results: NULL texts and texts without words have no runs. Rows without an id and rows of one id are
texts of their own. A very long text is worked on alone; it takes about 4 bytes a word for each
doubling until all blocks differ (6 or 7 in prose, log2 of the longest repeat in general), and as much
again for the matrix. An empty table gives an empty table. Only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
BATCH_WORDS = 1 << 16


class Blocks:
    """Names of all blocks of 2^k symbols, and the suffix array."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        now = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names, distinct, size = [now.astype(np.int32)], int(now.max()) + 1, 1
        while distinct < n:
            key = now * (n + 1)
            if size < n:
                key[:-size] += now[size:] + 1  # past the end counts as the smallest name
            now = np.unique(key, return_inverse=True)[1]
            self.names.append(now.astype(np.int32))
            distinct, size = int(now.max()) + 1, 2 * size
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[now] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from i and from j on; i < j."""
        off = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            at = j + off
            same = (at < self.n) & (self.names[k][np.minimum(i + off, self.n - 1)] == self.names[k][np.minimum(at, self.n - 1)])
            off += same.astype(np.int64) << k
        return off

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree before i and before j; i < j."""
        off = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            at = i - off - (1 << k)
            same = (at >= 0) & (self.names[k][np.maximum(at, 0)] == self.names[k][np.maximum(j - off - (1 << k), 0)])
            off += same.astype(np.int64) << k
        return off

    def stretch(self, i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch with period d through the symbols at i and i + d."""
        return i - self.behind(i, i + d), i + d + self.ahead(i, i + d)


class WaveletMatrix:
    """Rank and selection by value in any range of a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.ends = [], []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=count[1:])
            self.zeros.append(count)
            self.ends.append(int(count[-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Numbers in [left, right) that are smaller than the value."""
        over = value >= 1 << self.bits
        found = np.where(over, right - left, 0)
        for level, (zeros, end) in enumerate(zip(self.zeros, self.ends)):
            one = (value >> (self.bits - 1 - level)) & 1 == 1
            l0, r0 = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            found += np.where(one & ~over, r0 - l0, 0)
            left, right = np.where(one, end + left - l0, l0), np.where(one, end + right - r0, r0)
        return found

    def smallest(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number with that rank, from 0, of those in [left, right)."""
        found = np.zeros(len(left), np.int64)
        for level, (zeros, end) in enumerate(zip(self.zeros, self.ends)):
            l0, r0 = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            one = rank >= r0 - l0
            found |= one.astype(np.int64) << (self.bits - 1 - level)
            rank = np.where(one, rank - (r0 - l0), rank)
            left, right = np.where(one, end + left - l0, l0), np.where(one, end + right - r0, r0)
        return found


def windows(k: int, least: int) -> list[tuple[int, int]]:
    """Distances, first and last, at which a block of 2^k words looks for itself.

    Periods that twice fit into the least length are all found by blocks of two words, if three and the
    period fit into it.
    """
    size = 1 << k
    if k == 0:
        return []
    if k == 1:
        return [(d, d + 1) for d in range(1, max(7, least // 2 + 1), 2)]
    return [(2 * size - 1, 3 * size - 2), (3 * size - 1, 4 * size - 2)]


def repetitions(symbols: np.ndarray, least: int = LEAST, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run, by start and then period. ``longest`` bounds the length of a run."""
    n = len(symbols)
    nothing = np.zeros(0, np.int64)
    if n < least:
        return nothing, nothing, nothing
    longest = longest or n
    blocks = Blocks(symbols)
    if len(blocks.names) == 1:
        return nothing, nothing, nothing
    matrix = WaveletMatrix(blocks.suffixes)
    anchors, distances = [], []
    for k in range(1, len(blocks.names)):
        here = windows(k, least)
        if 2 * here[0][0] > longest:
            break
        at = np.arange(0, n, 1 << k)
        name = blocks.names[k]
        count = np.bincount(name)
        at = at[count[name[at]] > 1]
        if not len(at):
            continue
        first = np.cumsum(count) - count
        left = first[name[at]].astype(np.int64)
        right = left + count[name[at]]
        before = matrix.below(left, right, at + here[0][0])
        for _, last in here:
            upto = matrix.below(left, right, at + last + 1)
            some = np.flatnonzero(upto > before)
            if len(some):
                i, l, r, low, many = at[some], left[some], right[some], before[some], (upto - before)[some]
                one = matrix.smallest(l, r, low)
                few = many < 3
                anchors.append(i[few])
                distances.append(one[few] - i[few])
                i, l, r, low, one, many = (x[many > 1] for x in (i, l, r, low, one, many))
                two = matrix.smallest(l, r, low + 1)
                few = many < 3
                anchors.append(i[few])
                distances.append(two[few] - i[few])
                i, one, step, many = i[~few], one[~few], (two - one)[~few], many[~few]
                mine, theirs = blocks.stretch(i, step), blocks.stretch(one, step)
                for a, b in zip(mine, theirs):
                    anchors.append(i)
                    distances.append(b - a)
                meet = (theirs[0] <= mine[1]) & (theirs[0] > mine[0])
                i, one, step, many = i[meet], one[meet], step[meet], many[meet]
                turn = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                anchors.append(np.repeat(i, many))
                distances.append(np.repeat(one - i, many) + turn * np.repeat(step, many))
            before = upto
    i, d = np.concatenate(anchors or [nothing]), np.concatenate(distances or [nothing])
    good = (d > 0) & (i + d < n)
    i, d = i[good], d[good]
    start, end = blocks.stretch(i, d)
    good = end - start >= np.maximum(least, 2 * d)
    start, end, d = start[good], end[good], d[good]
    order = np.lexsort([d, end, start])
    start, end, d = start[order], end[order], d[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, d = start[new], end[new], d[new]
    order = np.lexsort([d, start])
    return start[order], end[order], d[order]


def words(text: str | None) -> list[bytes]:
    """bytes.split cuts at the blank and the five characters from tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, length and period of the runs of every row of words."""
    numbers, parts = Numbers(), []
    for row in texts:
        parts.append(np.fromiter(map(numbers.__getitem__, row), np.int64, len(row)))
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    symbols = np.concatenate([p + n * len(numbers) for n, p in enumerate(parts)]) if parts else np.zeros(0, np.int64)
    start, end, period = repetitions(symbols, least, int(sizes.max(initial=0)))
    cut = np.searchsorted(start, np.append(begin, len(symbols)))
    return [(start[a:b] - s, (end - start)[a:b], period[a:b]) for a, b, s in zip(cut[:-1].tolist(), cut[1:].tolist(), begin.tolist())]


def kept_words(row: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(start):
        return row
    step = np.zeros(len(row) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return [row[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def periodic_runs(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Per row: key_, n_ (words), runs_ (start, length, period) and collapsed_, the words kept.

    ``rewrite`` changes the words of a row before they are searched. ``hashed`` gives the SHA-256 of
    the collapsed text in place of it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[list[bytes]] = []
        held = 0

        def found() -> pa.RecordBatch:
            n, starts, lengths, periods, kept, offsets = [], [], [], [], [], [0]
            for row, (start, length, period) in zip(texts, runs_of(texts, least)):
                n.append(len(row))
                starts.append(start)
                lengths.append(length)
                periods.append(period)
                offsets.append(offsets[-1] + len(start))
                whole = b" ".join(kept_words(row, start, length, period))
                kept.append(hashlib.sha256(whole).hexdigest() if hashed else whole.decode("utf-8", "surrogatepass"))
            values = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(x), pa.int64()) for x in (starts, lengths, periods)], names=["start", "length", "period"]
            )
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(kept)],
                names=["key_", "n_", "runs_", "collapsed_"],
            )

        for batch in batches:
            for key_, value in zip(batch.column("key_").to_pylist(), batch.column("t_")):
                row = words(value.as_py())
                keys.append(key_)
                texts.append(rewrite(key_, row) if rewrite else row)
                held += len(row)
                if held >= BATCH_WORDS:
                    yield found()
                    keys, texts, held = [], [], 0
        if keys:
            yield found()

    named = df.select(F.col(f"`{key}`").cast("long").alias("key_"), F.col(f"`{text}`").cast("string").alias("t_"))
    return named.mapInArrow(rows, "key_ long, n_ long, runs_ array<struct<start: long, length: long, period: long>>, collapsed_ string")
