"""Token ids as fixed-width bit-packed blocks.

Every id takes the minimum number of bits of the vocabulary (16 for 50 257 ids), most significant
bit first. A block holds whole documents, its payload and the offsets that make it readable on
its own: first id within its shard, ids per document. A shard is one range of ascending document
ids. ``write`` stores, below one folder, Parquet tables ``blocks`` (shard, block, first, n_tokens,
doc_ids, doc_tokens, payload) and ``shards`` (shard, start, n_tokens, width, vocab, end_id); Spark's
writer commits them, so a lost executor repeats its tasks and leaves no half file behind. Numpy
unpacks a block, or any slice of it, without loops.

Text goes through the tokenizer in pieces: the vocabulary's byte-level splitter never joins text
across the cuts made here (before white characters that follow others, and between a Latin
letter and the punctuation behind it), so the ids of the pieces in a row are the ids of the
text, and a piece that a task has seen is not encoded again. New pieces that start with a blank go
through the tokenizer as one text. The table of pieces is bounded and ends with the task.

Defined results: a NULL or empty text is a document of the end id alone. Rows without an id come
first; equal ids keep one entry per row, ordered by a hash of the text. A special token written in
a text is that token, as in the library's own call; such a text is encoded whole. An empty table gives
empty tables. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableprobe.llm.batches import copied, tidy

BLOCK_TOKENS = 65_536
CACHED_PIECES = 500_000
ROWS_AT_ONCE = 256

# White space and letters as the vocabulary's splitter sees them.
SPACE = "\t-\r \x85\xa0  -     　"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = ".,!?;:"
PIECE = re.compile(rf"[{SPACE}]*+[{MARKS}]*+[^{SPACE}{MARKS}]*+(?:(?<![{LATIN}])[{MARKS}]++[^{SPACE}{MARKS}]*+)*+")
WHITE = {c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c)}


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as a stream of ``width``-bit numbers, most significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from number ``first`` on."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f">u{width // 8}", count, first * width // 8).astype(np.uint32)
    start, stop = first * width, (first + count) * width
    raw = np.frombuffer(payload, np.uint8, -(-stop // 8) - start // 8, start // 8)
    bits = np.unpackbits(raw)[start % 8 : start % 8 + count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width - 1, -1, -1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Numbered(dict):
    """Numbers keys as they come; ``ids`` from ``starts[n]`` to ``starts[n + 1]`` belong to key n."""

    def __init__(self):
        self.clear()

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def number(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the keys in ``new``."""
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.new = []

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered keys in a row, and where those of each key end."""
        lengths = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[numbers] - ends + lengths, lengths)], ends


@lru_cache(maxsize=1)
def tokenizer(path: str):
    """The tokenizer of this worker, with the library's defaults."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def blank_first(path: str) -> np.ndarray:
    """Which ids of a byte-level vocabulary begin with a blank (written as U+0120 there)."""
    entries = tokenizer(path).get_vocab()
    out = np.zeros(max(entries.values()) + 1, bool)
    out[[number for entry, number in entries.items() if entry.startswith("\u0120")]] = True
    return out


class PieceEncoder:
    """Encodes texts through a bounded table of the pieces seen so far; only new pieces meet the tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank_first = blank_first(path)
        self.pieces = Numbered()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without cutting them."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Ids of the new pieces. A piece whose only white character is the blank it starts with begins with a token
        that holds this blank, so many of them go through as one text and are told apart afterwards."""
        new = self.pieces.new
        if not new:
            return
        spaced = np.fromiter((p[0] == " " and p[-1] not in WHITE and p[1] not in WHITE for p in new), bool, len(new))
        joined = [p for p, s in zip(new, spaced.tolist()) if s]
        ids = self.whole(["".join(joined)])[0] if joined else np.empty(0, np.uint32)
        begins = np.flatnonzero(self.blank_first[ids])
        if len(begins) == len(joined):
            lengths = np.diff(begins, append=len(ids))
        else:
            some = self.whole(joined)
            lengths, ids = np.array([len(x) for x in some], np.int64), np.concatenate([*some, np.empty(0, np.uint32)])
        others = self.whole([p for p, s in zip(new, spaced.tolist()) if not s])
        count = np.empty(len(new), np.int64)
        count[spaced], count[~spaced] = lengths, [len(x) for x in others]
        every, of_spaced = np.empty(int(count.sum()), np.uint32), np.repeat(spaced, count)
        every[of_spaced], every[~of_spaced] = ids, np.concatenate([*others, np.empty(0, np.uint32)])
        self.pieces.learn(every, count)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        numbers, marked = [], {}
        for n, text in enumerate(texts):
            if any(token in text for token in self.special):
                marked[n] = self.whole([text])[0]
                text = ""
            numbers.append(self.pieces.number(PIECE.findall(text)[:-1]))  # the last match is empty
        self._learn()
        counts = np.array([len(n) for n in numbers], np.int64)
        ids, ends = self.pieces.gather(np.concatenate(numbers) if numbers else np.empty(0, np.int64))
        out = np.split(ids, np.concatenate([[0], ends])[np.cumsum(counts)][:-1]) if texts else []
        return [marked.get(n, x) for n, x in enumerate(out)]


def vocabulary(path: str) -> tuple[int, int]:
    """Size of a vocabulary and bits per id."""
    size = tokenizer(path).get_vocab_size()
    return size, max(1, (size - 1).bit_length())


def write(
    df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encode every text, append ``end_id``, and store the packed ids below ``folder``."""
    spark = df.sparkSession
    size, width = vocabulary(path)
    if not 0 <= end_id < size:
        raise ValueError(f"the end id {end_id} is not in the vocabulary of {size}")
    docs = df.select(F.col(f"`{key}`").cast("long").alias("key_"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t_"))
    tie = F.xxhash64("t_")
    ordered = docs.repartitionByRange(F.col("key_").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("key_").asc_nulls_first(), tie
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = PieceEncoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        keys, parts, lengths, held, first, block = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.concatenate(parts), width)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                names=["shard", "block", "first", "n_tokens", "doc_ids", "doc_tokens", "payload"],
            )

        for batch in copied(batches, ROWS_AT_ONCE):
            for key_, ids in zip(batch.column("key_").to_pylist(), coder.encode(batch.column("t_").to_pylist())):
                keys.append(key_)
                parts += [ids, end]
                lengths.append(len(ids) + 1)
                held += len(ids) + 1
                if held >= block_tokens:
                    yield flush()
                    first, block = first + held, block + 1
                    keys, parts, lengths, held = [], [], [], 0
        if keys:
            yield flush()

    ordered.mapInArrow(
        tidy(blocks),
        "shard int, block int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary",
    ).write.mode("overwrite").parquet(f"{folder}/blocks")
    # One row per shard, as many as the write had tasks: a running sum over them is small.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    sizes.select(
        "shard",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"),
        "n_tokens",
        F.lit(width).alias("width"),
        F.lit(size).alias("vocab"),
        F.lit(end_id).alias("end_id"),
    ).write.mode("overwrite").parquet(f"{folder}/shards")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The stored blocks with the number of the first id in the whole store as ``start``."""
    shards = spark.read.parquet(f"{folder}/shards").select("shard", F.col("start").alias("shard_start"), "width")
    return (
        spark.read.parquet(f"{folder}/blocks")
        .join(shards, "shard")
        .withColumn("start", F.col("shard_start") + F.col("first"))
        .drop("shard_start", "first")
    )


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: key_, start, n_tokens, ids_crc32 and, on demand, the ids."""
    columns = ["start", "width", "doc_ids", "doc_tokens", "payload"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, width, keys, sizes, payload = (batch.column(c)[row].as_py() for c in columns)
                sizes = np.array(sizes, np.int64)
                ends = np.cumsum(sizes)
                ids = unpack(payload, width, 0, int(ends[-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                arrays = [pa.array(keys, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["key_", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "key_ long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return read_blocks(spark, folder).select(*columns).mapInArrow(tidy(documents), schema)


def read_ids(spark: SparkSession, folder: str, start: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids from number ``start`` on; only the blocks that hold them are read."""
    end = F.col("start") + F.col("n_tokens")
    rows = read_blocks(spark, folder).where((F.col("start") < start + count) & (end > start)).orderBy("start").collect()
    parts = []
    for row in rows:
        low, high = max(start - row.start, 0), min(start + count - row.start, row.n_tokens)
        parts.append(unpack(row.payload, row.width, low, high - low))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
