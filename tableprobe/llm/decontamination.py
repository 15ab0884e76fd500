"""Benchmark decontamination by greedy string tiling.

A document and a test item are compared when they share a seed of five tokens. Tiling then marks,
again and again, the longest matches of tokens that are not marked yet and do not overlap, by
running Karp-Rabin: hashes of the search length on both sides, extended and verified token by
token, with the search length falling from the longest seed run to the minimum match. Coverage is
the share of the item's tokens under tiles, so passages that were cut up and put in another order
are found as well. Tokens are runs of letters, digits and underscores in lower case.

The benchmark goes through the documents in blocks of bounded size: a block (item tokens and a
sorted table of seed hashes) is broadcast, every document is scanned once per block, and no row
is shuffled. So neither a passage that very many documents share nor a large benchmark gathers
rows in one task.

Defined results: NULL or empty texts and items match nothing; items with fewer tokens than a seed
match as whole sequences. Repeated rows are compared one by one. A pair is returned per document
row and item with a tile; an empty table on either side gives no pairs. Only id and text columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.batches import copied, tidy
from tableprobe.llm.words import WordHashes, grams, word_hashes

TOKEN = re.compile(r"\w+")
SEED_TOKENS = 5
MIN_TILE = 3
MIN_COVERAGE = 0.7
BLOCK_TOKENS = 2_000_000
FILTER_BITS = 22
ROWS_AT_ONCE = 512


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def tiles(doc: np.ndarray, item: np.ndarray, minimum: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two rows of token hashes: (item start, document start, length)."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    common = np.isin(doc, item)
    out: list[tuple[int, int, int]] = []
    length = max(minimum, len(item) // 2)
    while True:
        # Runs of the search length of unmarked tokens, by hash.
        at: dict[int, list[int]] = defaultdict(list)
        for start, h in enumerate(grams(item, length).tolist()):
            if free_item[start : start + length].all():
                at[h].append(start)
        found: list[tuple[int, int, int]] = []
        if at:
            hashes = grams(doc, length)
            near = np.flatnonzero(np.isin(hashes, np.fromiter(at, np.uint64, len(at)))) if len(hashes) else []
            longest: dict[int, int] = {}  # per diagonal, where the last match ended
            for start in near:
                start = int(start)
                if not free_doc[start : start + length].all():
                    continue
                for first in at[int(hashes[start])]:
                    if longest.get(start - first, -1) >= start + length:
                        continue
                    size = 0
                    while (
                        first + size < len(item)
                        and start + size < len(doc)
                        and common[start + size]
                        and doc[start + size] == item[first + size]
                        and free_doc[start + size]
                        and free_item[first + size]
                    ):
                        size += 1
                    longest[start - first] = start + size
                    if size >= length:
                        found.append((size, first, start))
        again = False
        # Longest first; a match that a longer one has cut is looked at in the next pass.
        for size, first, start in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[first : first + size].all() and free_doc[start : start + size].all():
                free_item[first : first + size] = False
                free_doc[start : start + size] = False
                out.append((first, start, size))
            elif size > length:
                again = True
        if again:
            continue
        if length == minimum:
            return out
        length = max(minimum, length // 2)


class Block:
    """Part of the benchmark as it is broadcast: tokens of its items and their seeds."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int):
        words = WordHashes()
        self.ids = [i for i, _ in items]
        self.items = [words.of(t) for _, t in items]
        pairs = [(int(h), n) for n, item in enumerate(self.items) for h in set(grams(item, min(seed, len(item))).tolist())]
        pairs.sort()
        self.seeds = np.array([h for h, _ in pairs], np.uint64)
        self.owner = np.array([n for _, n in pairs], np.int64)
        self.sizes = sorted({min(seed, len(item)) for item in self.items if len(item)})
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.seeds & np.uint64((1 << FILTER_BITS) - 1)] = True

    def candidates(self, doc: np.ndarray) -> list[int]:
        """Items that share a seed with a document."""
        out: set[int] = set()
        for size in self.sizes:
            hashes = grams(doc, size)
            hashes = np.unique(hashes[self.filter[hashes & np.uint64((1 << FILTER_BITS) - 1)]])
            low, high = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
            for a, b in zip(low.tolist(), high.tolist()):
                out.update(self.owner[a:b].tolist())
        return sorted(out)


def blocks(benchmark: DataFrame, key: str, text: str, seed: int, block_tokens: int) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_tokens`` tokens (or one item), one at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    for row in rows.where(F.col("k").isNotNull() & F.col("t").isNotNull()).toLocalIterator():
        item = tokens(row.t)
        if not item:
            continue
        if held and size + len(item) > block_tokens:
            yield Block(held, seed)
            held, size = [], 0
        held.append((row.k, item))
        size += len(item)
    if held:
        yield Block(held, seed)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    seed: int = SEED_TOKENS,
    minimum: int = MIN_TILE,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Documents and items that share a tile: key_, item_, n_tiles, tiled, item_tokens, coverage.

    ``spans`` lists the tiles as (item start, document start, length) in tokens. Item ids are
    whole numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key_"), F.col(f"`{text}`").cast("string").alias("t_"))
    schema = "key_ long, item_ long, n_tiles long, tiled long, item_tokens long, spans array<array<int>>"
    fields = pa.schema(
        [(n, pa.int64()) for n in ("key_", "item_", "n_tiles", "tiled", "item_tokens")]
        + [("spans", pa.list_(pa.list_(pa.int32())))]
    )
    out = None
    for block in blocks(benchmark, item_key, item_text, seed, block_tokens):
        shared = spark.sparkContext.broadcast(block)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in copied(batches, ROWS_AT_ONCE):
                found = []
                for key_, value in zip(batch.column("key_"), batch.column("t_")):
                    doc = word_hashes(tokens(value.as_py()))
                    for n in block.candidates(doc):
                        item = block.items[n]
                        cut = tiles(doc, item, min(minimum, len(item)))
                        if cut:
                            found.append(
                                {
                                    "key_": key_.as_py(),
                                    "item_": block.ids[n],
                                    "n_tiles": len(cut),
                                    "tiled": sum(size for _, _, size in cut),
                                    "item_tokens": len(item),
                                    "spans": [list(tile) for tile in sorted(cut)],
                                }
                            )
                yield pa.RecordBatch.from_pylist(found, schema=fields)

        part = rows.mapInArrow(tidy(compare), schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("coverage", F.col("tiled") / F.col("item_tokens"))


def contaminated(pairs: DataFrame, coverage: float = MIN_COVERAGE) -> DataFrame:
    """Pairs in which at least ``coverage`` of the item lies in the document."""
    return pairs.where(F.col("coverage") >= coverage)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    coverage: float = MIN_COVERAGE,
    seed: int = SEED_TOKENS,
    minimum: int = MIN_TILE,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The rows of ``docs`` in which no item is covered that far, with all their columns.

    Rows are dropped where they are scanned, one pass per block of the benchmark, without a join.
    """
    for block in blocks(benchmark, item_key, item_text, seed, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in copied(batches, ROWS_AT_ONCE):
                mask = []
                for value in batch.column(batch.schema.get_field_index(text)):
                    doc = word_hashes(tokens(value.as_py()))
                    mask.append(
                        all(
                            sum(size for *_, size in tiles(doc, block.items[n], min(minimum, len(block.items[n]))))
                            < coverage * len(block.items[n])
                            for n in block.candidates(doc)
                        )
                    )
                yield batch.filter(pa.array(mask, pa.bool_()))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs
