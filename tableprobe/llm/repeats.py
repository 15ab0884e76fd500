"""Substring dedup by recompression.

Every document is a row of word symbols. A round names runs of one symbol (symbol, length), then
pairs: a symbol is a left or a right one by a coin that depends on the symbol alone, and a left
one followed by a right one becomes a new symbol. Names are hashes of what they stand for, so
equal text gets equal names in every document, without a shared table of names: inside a repeat
all symbols agree, only near its ends they depend on what is around. For each symbol the words
that fix it (its context) are carried along.

Candidates: a window of 13 words has the symbols whose context lies in the window. It is known by
the smallest (by hash) of those of the highest level, widened by half of the words the window has
besides it, to the side on which the window has more of them. That name depends on the words of
the window alone and neighbouring windows mostly share it, so there are far fewer names than
windows. Windows without any such symbol (long runs) are known by their words.

A whole text is the last symbol of all: of texts with the same words only the one with the
smallest id is looked at further, the others lose everything.

Spark sorts the names; those found in two or more documents go back to the documents that have
them, whose windows with such a name are hashed (128 bits) and sorted once more: a window whose
words start in a document with a smaller id marks its words, wherever that document has it. A
name or window has one row per document, rows of one name are read as a stream, and only its smallest id is remembered, so a
passage that very many documents share needs no memory.

Defined results: NULL and empty texts have no words; texts shorter than a window lose none. Rows
without an id neither lose words nor cause a loss; rows with the same id do not make each other
lose words. An empty table gives an empty table. Only id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.words import RunHashes, WordHashes, chain, mix

WINDOW = 13
ROUNDS = 2
TEXTS = 64  # texts that are named together


class Level:
    """Symbols of one level: name, first word, word count, and the words that fix each symbol."""

    def __init__(self, name, first, size, low, high):
        self.name, self.first, self.size, self.low, self.high = name, first, size, low, high


def words_level(hashes: np.ndarray) -> Level:
    at = np.arange(len(hashes), dtype=np.int64)
    return Level(hashes, at, np.ones(len(hashes), np.int64), at, at + 1)


def _next_context(level: Level, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Context of the symbol before and of the one after each symbol; past the ends nothing fits."""
    low_before = np.concatenate([[-1], level.low[:-1]])
    high_after = np.concatenate([level.high[1:], [total + 1]])
    return low_before, high_after


def name_runs(level: Level, total: int, number: int) -> Level:
    """Runs of one symbol become one symbol, known by the symbols on both sides of the run."""
    n = len(level.name)
    starts = np.flatnonzero(np.concatenate([[True], level.name[1:] != level.name[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    count = (ends - starts).astype(np.uint64)
    low, high = _next_context(level, total)
    name = level.name[starts]
    runs = count > 1
    name = np.where(runs, chain([name, count, np.full(len(name), number, np.uint64)]), name)
    size = level.first[ends - 1] + level.size[ends - 1] - level.first[starts]
    return Level(name, level.first[starts], size, low[starts], high[ends - 1])


def name_pairs(level: Level, total: int, number: int) -> Level:
    """Left symbols followed by right ones become pairs."""
    n = len(level.name)
    right = (mix(level.name + np.uint64(number)) & np.uint64(1)).astype(bool)
    opens = np.zeros(n, bool)
    opens[:-1] = ~right[:-1] & right[1:]
    closes = np.concatenate([[False], opens[:-1]])
    low, high = level.low.copy(), level.high.copy()
    # A left symbol looks at the one after it, a right symbol at the one before it.
    low_before, high_after = _next_context(level, total)
    low = np.where(right, np.minimum(low, low_before), low)
    high = np.where(right, high, np.maximum(high, high_after))
    keep = np.flatnonzero(~closes)
    pair = opens[keep]
    second = np.minimum(keep + 1, n - 1)
    name = np.where(pair, chain([level.name[keep], level.name[second]]), level.name[keep])
    size = level.size[keep] + np.where(pair, level.size[second], 0)
    low, high = (
        np.where(pair, np.minimum(low[keep], low[second]), low[keep]),
        np.where(pair, np.maximum(high[keep], high[second]), high[keep]),
    )
    return Level(name, level.first[keep], size, low, high)


def levels(hashes: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Symbols after each round, the highest level first."""
    total, level, out = len(hashes), words_level(hashes), []
    for number in range(1, rounds + 1):
        level = name_pairs(name_runs(level, total, number), total, number)
        out.append(level)
    return out[::-1]


def window_names(hashes: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The name of every window, by the position of its first word."""
    total = len(hashes)
    count = total - window + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    start = np.arange(count, dtype=np.int64)
    anchor, length = np.full(count, -1, np.int64), np.zeros(count, np.int64)
    open_ = np.ones(count, bool)
    for level in levels(hashes, rounds):
        # Contexts only move to the right: the symbols of a window lie side by side.
        first = np.searchsorted(np.maximum.accumulate(level.low), start, "left")
        last = np.searchsorted(np.minimum.accumulate(level.high[::-1])[::-1], start + window, "right")
        best = np.full(count, -1, np.int64)
        order = mix(level.name)
        most = int((last - first).max()) if count else 0
        value = np.full(count, np.iinfo(np.uint64).max, np.uint64)
        for k in range(max(0, most)):
            at = first + k
            inside = at < last
            at = np.minimum(at, len(order) - 1)
            inside &= (level.low[at] >= start) & (level.high[at] <= start + window)
            better = inside & ((order[at] < value) | (best < 0))
            best, value = np.where(better, at, best), np.where(better, order[at], value)
        found = open_ & (best >= 0)
        anchor[found] = level.first[best[found]]
        length[found] = level.size[best[found]]
        open_ &= ~found
        if not open_.any():
            break
    runs = RunHashes(hashes)
    left = anchor - start
    wide = length + (window - length + 1) // 2
    begin = np.where(left >= window - length - left, anchor + length - wide, anchor)
    # Windows without a symbol are known by all their words.
    return runs.of(np.where(open_, start, begin), np.where(open_, window, wide))


def names_of_texts(texts: list[np.ndarray], window: int = WINDOW, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Window names of several texts in one go.

    A separator stands between texts. It can only touch symbols whose context reaches over the
    end of a text, and those are in no window of it.
    """
    if not texts:
        return []
    gap = np.zeros(1, np.uint64)
    joined = np.concatenate([part for text in texts for part in (text, gap)])
    names = window_names(joined, window, rounds)
    ends = np.cumsum([len(text) + 1 for text in texts])
    return [names[end - 1 - len(text) : max(end - window, end - 1 - len(text))] for end, text in zip(ends.tolist(), texts)]


def window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per window."""
    return RunHashes(hashes).of(starts, window), RunHashes(hashes, 0xC2B2AE3D27D4EB4F).of(starts, window)


def whole_hash(words: list[bytes]) -> tuple[int, int]:
    """128 bits of all words, as two signed numbers."""
    both = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def split(text: str | None) -> list[bytes]:
    """Words of a text; bytes.split cuts at the same six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _repeats(sorted_rows: DataFrame, keys: list[str], schema: str, columns: list[str]) -> DataFrame:
    """Of rows sorted by ``keys`` and then ``doc_``: those whose keys occur in two documents.

    Each comes with ``least_``, the smallest document of its keys; of that document one row per
    key is enough. Rows stream by; of the group that is open only its first row is kept.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # first row of the open group
        given = False  # whether that row has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            rows = {c: np.concatenate([held[c], now[c]]) for c in columns} if held else now
            doc = rows["doc_"]
            fresh = np.concatenate([[True], np.zeros(len(doc) - 1, bool)])
            for k in keys:
                fresh[1:] |= rows[k][1:] != rows[k][:-1]
            first = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            least = doc[first][group]
            later = doc != least
            shared = np.zeros(len(first), bool)
            shared[group[later]] = True
            out = later | (fresh & shared[group])
            if given:
                out[0] = False
            given = bool(shared[-1]) or (given and len(first) == 1)
            held = {c: rows[c][first[-1] : first[-1] + 1] for c in columns}
            if out.any():
                arrays = [pa.array(rows[c][out]) for c in columns] + [pa.array(least[out])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "least_"])

    return sorted_rows.select(*columns).mapInArrow(mark, schema + ", least_ long")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Every row: key_, n_words_, n_removed_ and the words that stay, joined by spaces, as kept_."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_"), F.col(f"`{text}`").cast("string").alias("t_"))
    # Rows without an id are spread by their text; the joins below share one shuffle of the texts.
    docs = docs.withColumn("link_", F.coalesce("doc_", F.xxhash64("t_")))

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, a, b = [], [], []
            for doc, value in zip(batch.column("doc_").to_pylist(), batch.column("t_")):
                words = split(value.as_py())
                if len(words) >= window:
                    one, two = whole_hash(words)
                    ids.append(doc)
                    a.append(one)
                    b.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, ids)], names=["a_", "b_", "doc_"])

    keys = "a_ long, b_ long, doc_ long"
    whole = docs.where(F.col("doc_").isNotNull() & F.col("t_").isNotNull()).select("doc_", "t_").mapInArrow(wholes, keys)
    whole = whole.repartition("a_", "b_").sortWithinPartitions("a_", "b_", "doc_")
    again = _repeats(whole, ["a_", "b_"], keys, ["a_", "b_", "doc_"]).where("doc_ > least_")
    # One hash per document, and per text where rows share an id.
    copies = again.groupBy(F.col("doc_").alias("link_")).agg(F.collect_set("a_").alias("copy_"))
    known = docs.join(copies, "link_", "left").select("doc_", "t_", "copy_")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            ids, out = [], []
            docs_of, copy_of = batch.column("doc_").to_pylist(), batch.column("copy_").to_pylist()
            for at in range(0, batch.num_rows, TEXTS):
                some = [n for n in range(at, min(at + TEXTS, batch.num_rows)) if docs_of[n] is not None]
                texts = [split(batch.column("t_")[n].as_py()) for n in some]
                fresh = [k for k, n in enumerate(some) if not copy_of[n] or whole_hash(texts[k])[0] not in copy_of[n]]
                named = names_of_texts([table.of(texts[k]) for k in fresh], window, rounds)
                for doc, found in zip([docs_of[some[k]] for k in fresh], named):
                    found = np.unique(found)
                    if len(found):
                        out.append(found.view(np.int64))
                        ids.append(np.full(len(found), doc, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(ids))], names=["name_", "doc_"])

    named = known.mapInArrow(names, "name_ long, doc_ long").repartition("name_").sortWithinPartitions("name_", "doc_")
    shared = _repeats(named, ["name_"], "name_ long, doc_ long", ["name_", "doc_"])
    # As many names per document as it has windows, at most.
    by_doc = shared.groupBy(F.col("doc_").alias("link_")).agg(F.collect_set("name_").alias("names_"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            a, b, ids, at = [], [], [], []
            docs_of, names_of = batch.column("doc_").to_pylist(), batch.column("names_")
            mine = [n for n, doc in enumerate(docs_of) if doc is not None and names_of[n].is_valid]
            for begin in range(0, len(mine), TEXTS):
                some = mine[begin : begin + TEXTS]
                texts = [table.of(split(batch.column("t_")[n].as_py())) for n in some]
                for n, hashes, names in zip(some, texts, names_of_texts(texts, window, rounds)):
                    wanted = names_of[n].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    starts = np.flatnonzero(np.isin(names, wanted))
                    if len(starts):
                        one, two = window_hashes(hashes, starts, window)
                        _, first = np.unique(one, return_index=True)  # one row for each window
                        one, two, starts = one[first], two[first], starts[first]
                        a.append(one.view(np.int64))
                        b.append(two.view(np.int64))
                        ids.append(np.full(len(starts), docs_of[n], np.int64))
                        at.append(starts)
            if a:
                arrays = [pa.array(np.concatenate(x)) for x in (a, b, ids, at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a_", "b_", "doc_", "at_"])

    columns = "a_ long, b_ long, doc_ long, at_ long"
    found = docs.join(by_doc, "link_", "left").select("doc_", "t_", "names_").mapInArrow(windows, columns)
    found = found.repartition("a_").sortWithinPartitions("a_", "b_", "doc_")
    again = _repeats(found, ["a_", "b_"], columns, ["a_", "b_", "doc_", "at_"]).where("doc_ > least_")
    starts = again.groupBy(F.col("doc_").alias("link_")).agg(F.collect_set("at_").alias("at_"))
    marked = docs.join(starts, "link_", "left").join(copies, "link_", "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            table = WordHashes()
            for doc, value, at, copy in zip(*(batch.column(c) for c in ("doc_", "t_", "at_", "copy_"))):
                words = split(value.as_py())
                cover = np.zeros(len(words) + 1, np.int64)
                if copy.is_valid and doc.is_valid and whole_hash(words)[0] in copy.as_py():
                    cover[0] = 1
                elif at.is_valid and doc.is_valid:
                    first = at.values.to_numpy(zero_copy_only=False)
                    first = first[first + window <= len(words)]  # of another row with the same id
                    every = np.arange(len(words) - window + 1)
                    all_hashes, _ = window_hashes(table.of(words), every, window) if len(first) else (every, every)
                    first = every[np.isin(all_hashes, all_hashes[first])] if len(first) else first
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + window, -1)
                out = np.cumsum(cover)[:-1] > 0
                total.append(len(words))
                gone.append(int(out.sum()))
                if gone[-1]:
                    words = [w for w, o in zip(words, out.tolist()) if not o]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["key_", "n_words_", "n_removed_", "kept_"],
            )

    return marked.select("doc_", "t_", "at_", "copy_").mapInArrow(rest, "key_ long, n_words_ long, n_removed_ long, kept_ string")

