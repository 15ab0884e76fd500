"""Cross-tokenizer alignment of two vocabularies over the same bytes.

Every text is encoded by a byte-level vocabulary A and a piece vocabulary B. Where tokens of both end
at the same byte, the text is cut; what lies between two cuts is a group, and the tokens of A and
B whose bytes overlap are linked. The table of links tells which tokens of B stand for a token of A.

The identity map, an array from A ids to the B ids of the same bytes, is made once from the
vocabularies. A group of one token on each side that agrees with it is counted in a vector as
long as the vocabulary, one per task; vectors are added up in a tree. Only links outside the
identity map enter the shuffle of pairs, and those are counted inside each task first. The
documents' own links stay with them in a written table, so no text is encoded twice.

To read the counts back, the vector and the most frequent pairs (each above 1 / 65 536 of all, so
at most 65 536 of them) are broadcast; rarer pairs are joined by a shuffle in which no key can hold
more than that share of the rows.

Text is encoded in units, cut before white characters and between a letter and the mark behind it.
Neither vocabulary joins tokens across such a place: the splitter of A starts a piece there, and the
pieces of B are checked when they are loaded. Units met before in a task are not encoded again; the
table of units is bounded and lives as long as the task.

Defined results: NULL and empty texts, and texts whose tokens do not spell a space and the text (B
reads U+2581 as a space), have no tokens, zeros and an empty string of groups. Rows without an id and
rows of one id are documents of their own. Strings of special tokens are ordinary text. Very
long texts are one row; their links are kept as distinct pairs with numbers. An empty table gives
an empty table. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.tables import stored

LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SHIFT = 20  # a pair is one number: the A id above, the B id in the lower 20 bits
FREQUENT = 65_536
UNITS, UNIT_CHARACTERS = 200_000, 8_000_000  # bounds of a task's table
COUNTED_AT_ONCE = 1 << 20
FAN_IN = 32


def byte_alphabet() -> dict[str, int]:
    """The byte of every character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(alphabet[c] for c in names[i]) if all(c in alphabet for c in names.get(i, "\0")) else b"" for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        marked = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(pieces))]
        self.b_bytes = [
            b"" if m else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, (p, m) in enumerate(zip(pieces, marked))
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << SHIFT:
            raise ValueError(f"a vocabulary has more than {1 << SHIFT} entries")
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        # Of several B ids with the same bytes the written piece comes before the single byte.
        spelled = {self.b_bytes[i]: i for i in sorted(range(len(pieces)), key=lambda i: (not self.b.is_byte(i), -i)) if self.b_bytes[i]}
        self.same = np.array([spelled.get(x, -1) for x in self.a_bytes], np.int64)
        self.blank = self.b.piece_to_id("▁")
        written = [p for i, p in enumerate(pieces) if not marked[i] and not self.b.is_byte(i)]
        self.cut = cuts(written)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of every unit. B puts a blank before a text: a unit that starts with one is
        given without it, any other one after a line break, which joins nothing."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        return a, [[self.blank] if u == " " else ids if u[0] == " " else ids[2:] for u, ids in zip(units, b)]


def cuts(pieces: list[str]) -> re.Pattern:
    """Where a text may be cut: no token of A or B goes across.

    That is before a blank, line break or tab that follows a visible character, and between a Latin letter and the mark
    behind it; each as far as no written piece of B goes on there.
    """
    if any("\n" in p for p in pieces) or any("▁" in p.lstrip("▁") for p in pieces):
        return re.compile(r"(?!)")
    white = "".join(c for c in " \n\t" if not any(c in p for p in pieces))
    marks = "".join(c for c in ".,!?;:" if not any(re.search(rf"[{LATIN}]{re.escape(c)}", p) for p in pieces))
    return re.compile(rf"(?<=\S)(?=[{white}])" + (rf"|(?<=[{LATIN}])(?=[{marks}])" if marks else ""))


@lru_cache(maxsize=1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """The vocabularies of this worker: of fixed size, whatever texts it has met."""
    return Vocabularies(path_a, path_b)


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of linked A and B tokens, and where groups end.

    Between two neighbouring ends of either side lies one stretch of bytes that belongs to one token of
    each side; it is their overlap.
    """
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), np.intersect1d(a_ends, b_ends, assume_unique=True)


class Units(dict):
    """Alignment of every unit met: a number per unit, and what belongs to the numbers."""

    def __init__(self, both: Vocabularies):
        self.both = both
        self.start()

    def start(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.characters = 0
        self.sizes = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.texts: list[str] = []
        self.codes = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        self.characters += len(unit)
        return number

    def learn(self) -> None:
        """Align the units that are new, all at once: laid end to end, both sides cut the same bytes."""
        if not self.new:
            return
        both = self.both
        units, (a, b) = self.new, both.encode(self.new)
        spelled = [unit.encode() for unit in units]
        fine = np.ones(len(units), bool)
        for ids, names in ((a, both.a_bytes), (b, both.b_bytes)):
            if [b"".join(map(names.__getitem__, x)) for x in ids] != spelled:
                fine &= [b"".join(map(names.__getitem__, x)) == s for x, s in zip(ids, spelled)]
        if not fine.all():
            a, b = ([x if ok else [] for x, ok in zip(ids, fine.tolist())] for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        a, b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(both.a_length[ids_a]), np.cumsum(both.b_length[ids_b])
        at_a, at_b, cuts = links(a_ends, b_ends)
        stop_a, stop_b = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        # Where the links and the groups of every unit end.
        last_a = np.cumsum(n_a)
        end_links, end_groups = np.searchsorted(at_a, last_a), np.searchsorted(stop_a, last_a, "right")
        n_links, n_groups = np.diff(end_links, prepend=0), np.diff(end_groups, prepend=0)
        names_a, names_b = list(map(str, a)), list(map(str, b))
        groups, i, j = [], 0, 0
        for x, y in zip(stop_a.tolist(), stop_b.tolist()):
            groups.append(f"{names_a[i] if x - i == 1 else ','.join(names_a[i:x])}|{names_b[j] if y - j == 1 else ','.join(names_b[j:y])}")
            i, j = x, y
        start = 0
        for end in end_groups.tolist():
            self.texts.append(groups[start] if end - start == 1 else ";".join(groups[start:end]))
            start = end
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.good = np.concatenate([self.good, fine])
        self.codes = np.concatenate([self.codes, ids_a[at_a] << SHIFT | ids_b[at_b]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])
        self.new = []

    def numbers(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The units of every text by number."""
        if len(self) > UNITS or self.characters > UNIT_CHARACTERS:
            self.start()
        found = [self.both.cut.split(" " + t) if t else None for t in texts]
        out = [np.fromiter(map(self.__getitem__, u), np.int64, len(u)) if u else None for u in found]
        self.learn()
        return out

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """All links of a text as codes."""
        starts = self.starts[numbers]
        lengths = self.starts[numbers + 1] - starts
        ends = np.cumsum(lengths)
        return self.codes[np.arange(int(ends[-1])) + np.repeat(starts - ends + lengths, lengths)]


ROWS = pa.schema(
    [("kind_", pa.int32()), ("row_", pa.int64()), ("key_", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_", pa.string())]
    + [(c, pa.list_(pa.int64())) for c in ("same_", "same_n_", "codes_", "codes_n_")]
)
DDL = (
    "kind_ int, row_ long, key_ long, n_a long, n_b long, n_groups long, n_links long, groups_ string, "
    "same_ array<long>, same_n_ array<long>, codes_ array<long>, codes_n_ array<long>"
)
DOCUMENT, VECTOR, PAIRS = 0, 1, 2


def encoded(df: DataFrame, path_a: str, path_b: str, key: str, text: str, hashed: bool) -> DataFrame:
    """One row per document with its sizes, groups and distinct links, and the counts of each task.

    Kind 0 are documents (same_: A ids linked to what the identity map names; codes_: other pairs; each with
    the number of links). Kind 1 has the task's vector: how many documents hold each A id so linked. Kind 2
    has the task's other pairs with their numbers of documents.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(path_a, path_b)
        units, number = Units(both), TaskContext.get().partitionId() << 33
        vector = np.zeros(len(both.same), np.int64)
        seen: list[np.ndarray] = []
        waiting = 0

        def table(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in ROWS], schema=ROWS)

        def counted() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            return table({"kind_": [PAIRS], "codes_": [codes], "codes_n_": [n]})

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column("t_").to_pylist()
                out: dict[str, list] = {f.name: [] for f in ROWS}
                for key_, numbers in zip(part.column("key_").to_pylist(), units.numbers(texts)):
                    values = [0, 0, 0, 0, "", [], [], [], []]
                    if numbers is not None and units.good[numbers].all():
                        values[:4] = units.sizes[numbers].sum(axis=0).tolist()
                        whole = ";".join([units.texts[k] for k in numbers.tolist()])
                        values[4] = hashlib.sha256(whole.encode()).hexdigest() if hashed else whole
                        codes, n = np.unique(units.gather(numbers), return_counts=True)
                        a, b = codes >> SHIFT, codes & ((1 << SHIFT) - 1)
                        same = both.same[a] == b
                        values[5:] = a[same], n[same], codes[~same], n[~same]
                        vector[a[same]] += 1
                        seen.append(codes[~same])
                        waiting += len(seen[-1])
                    for name, value in zip(ROWS.names, [DOCUMENT, number, key_, *values]):
                        out[name].append(value)
                    number += 1
                yield table(out)
                if waiting >= COUNTED_AT_ONCE:
                    waiting = 0
                    yield counted()
        if waiting:
            yield counted()
        if vector.any():
            yield table({"kind_": [VECTOR], "same_n_": [vector]})

    named = df.select(F.col(f"`{key}`").cast("long").alias("key_"), F.col(f"`{text}`").cast("string").alias("t_"))
    return named.mapInArrow(rows, DDL)


def added(vectors: DataFrame) -> np.ndarray | None:
    """The sum of all vectors, added up in a tree of tasks; the driver sees one vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column("same_n_"):
                value = row.values.to_numpy()
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["same_n_"])

    level = vectors.select("same_n_")
    parts = level.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        level = level.mapInArrow(add, "same_n_ array<long>").repartition(parts)
    found = level.mapInArrow(add, "same_n_ array<long>").toArrow().column("same_n_")
    return found[0].values.to_numpy() if len(found) else None


class Alignment:
    """Documents and pairs of one corpus. ``pairs`` has code, a, b and n, the number of documents."""

    def __init__(self, df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", hashed: bool = True):
        self.rows = stored(encoded(df, path_a, path_b, key, text, hashed), "alignment")
        both = vocabularies(path_a, path_b)
        vector = added(self.rows.where(F.col("kind_") == VECTOR))
        self.vector = np.zeros(len(both.same), np.int64) if vector is None else vector
        self.same = both.same
        tasks = self.rows.where(F.col("kind_") == PAIRS).select(F.explode(F.arrays_zip("codes_", "codes_n_")).alias("p"))
        counted = tasks.groupBy(F.col("p.codes_").alias("code")).agg(F.sum("p.codes_n_").alias("n"))
        self.others = stored(counted.withColumns({"a": F.shiftright("code", SHIFT), "b": F.col("code").bitwiseAND((1 << SHIFT) - 1)}), "alignment")

    def pairs(self) -> DataFrame:
        """All linked pairs (a, b) with the number of documents that hold them."""
        spark = self.rows.sparkSession
        a = np.flatnonzero(self.vector)
        same = pa.table({"a": a, "b": self.same[a], "n": self.vector[a]})  # as long as the vocabulary at most
        return spark.createDataFrame(same).unionByName(self.others.select("a", "b", "n"))

    def documents(self) -> DataFrame:
        """Per document: key_, sizes, groups_, n_best and count_sum."""
        spark = self.rows.sparkSession
        most = self.others.groupBy("a").agg(F.max("n").alias("most")).toArrow()  # as long as the vocabulary at most
        best = self.vector.copy()
        ids = most.column("a").to_numpy()
        best[ids] = np.maximum(best[ids], most.column("most").to_numpy())
        total = self.others.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        frequent = F.col("n") * FREQUENT > F.lit(total)
        known = self.others.where(frequent).select("code", "n").toArrow().sort_by("code")  # fewer than FREQUENT rows
        held = spark.sparkContext.broadcast((self.vector, best, known.column("code").to_numpy(), known.column("n").to_numpy()))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vector, best, codes, counts = held.value
            for batch in batches:
                n_best, sums, rare, rare_n = [], [], [], []
                same, same_n, other, other_n = (batch.column(c) for c in ("same_", "same_n_", "codes_", "codes_n_"))
                for row in range(batch.num_rows):
                    a, n, code, m = (x[row].values.to_numpy() for x in (same, same_n, other, other_n))
                    c = vector[a]
                    good, total = int(n[c == best[a]].sum()), int((n * c).sum())
                    at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                    hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                    c, w = counts[at[hit]], m[hit]
                    good += int(w[c == best[code[hit] >> SHIFT]].sum())
                    n_best.append(good)
                    sums.append(total + int((w * c).sum()))
                    rare.append(code[~hit])
                    rare_n.append(m[~hit])
                plain = [batch.column(c) for c in PLAIN]
                arrays = [*plain, pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())]
                arrays += [pa.array(x, pa.list_(pa.int64())) for x in (rare, rare_n)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*PLAIN, "n_best", "count_sum", "rare_", "rare_n_"])

        ddl = "row_ long, key_ long, n_a long, n_b long, n_groups long, n_links long, groups_ string, n_best long, count_sum long, rare_ array<long>, rare_n_ array<long>"
        rows = self.rows.where(F.col("kind_") == DOCUMENT)
        counted = rows.select(*PLAIN, "same_", "same_n_", "codes_", "codes_n_").mapInArrow(count, ddl)
        rare = self.others.where(~frequent)
        if rare.isEmpty():
            return counted.drop("row_", "rare_", "rare_n_")
        counted = stored(counted, "alignment")
        bests = F.broadcast(spark.createDataFrame(pa.table({"a": ids, "best_": best[ids]})))  # as long as the vocabulary at most
        rare = rare.join(bests, "a").select("code", F.col("n").alias("c_"), (F.col("n") == F.col("best_")).cast("long").alias("is_best_"))
        held_by = counted.select("row_", F.explode(F.arrays_zip("rare_", "rare_n_")).alias("p"))
        held_by = held_by.select("row_", F.col("p.rare_").alias("code"), F.col("p.rare_n_").alias("w_"))
        more = held_by.join(rare, "code").groupBy("row_").agg(F.sum(F.col("w_") * F.col("c_")).alias("c_"), F.sum(F.col("w_") * F.col("is_best_")).alias("b_"))
        return (
            counted.drop("rare_", "rare_n_")
            .join(more, "row_", "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("b_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c_", F.lit(0))})
            .drop("row_", "b_", "c_")
        )


PLAIN = ["row_", "key_", "n_a", "n_b", "n_groups", "n_links", "groups_"]
