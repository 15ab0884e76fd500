"""Line dedup with a segment-partition edit join.

Lines of t allowed edits are cut into t + 1 segments; a line within t edits of another has one of
its segments unchanged, at a place that its number and the difference in length narrow down to a
few. So every distinct line is entered under its own segments (length, number, text) and looks up
its substrings under the segments of equal or slightly shorter lines. What meets under a key is
compared by a bag of its characters (each edit moves it by two at most) and then verified by a
banded bit-parallel edit distance on the texts.

Allowed edits: none below 20 characters, one below 40, two from there on. Lines are compared
without white space at their ends. An occurrence of a line goes if the same line or one within
the allowed edits (of the shorter of the two) occurs earlier, in order of document id and line
number.

Keys are sorted and read as a stream. Keys with many lines are compared in pairs of blocks, each in
a task of its own, so that no key gathers in one task. Occurrences meet the first occurrence of
their line in a join that Spark splits where a line is very common.

Defined results: lines without a word are never removed. NULL and empty texts have no such lines.
Rows without an id neither lose lines nor cause a loss; rows of one id count as one document. An
empty table gives an empty table. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.words import RunHashes, mix
from tableprobe.session import cut_lineage

MAX_EDITS = 2
CHARS_PER_EDIT = 20
SPACES = " \t\n\r\x0b\x0c"
NODE_LIMIT = 1024
TEXTS = 256  # texts whose keys are made together
BROADCAST_LINES = 2_000_000


def allowed(length: int) -> int:
    return min(MAX_EDITS, length // CHARS_PER_EDIT)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 segments of nearly equal length, the longer ones last."""
    count, at, out = edits + 1, 0, []
    short, longer = length // count, length % count
    for n in range(count):
        size = short + (n >= count - longer)
        out.append((at, size))
        at += size
    return out


def plan_keys(length: int) -> list[tuple[int, int, int, int, int]]:
    """What a line of a length enters and looks up: (indexed length, segment, start, size, role).

    Role 1 enters, role 2 looks up, role 3 does both.
    """
    out = []
    for other in range(max(1, length - MAX_EDITS), length + 1):
        edits, more = allowed(other), length - other
        if edits == 0 or more > edits:
            continue
        for n, (start, size) in enumerate(segments(other, edits)):
            low = max(start - n, start + more - (edits - n), 0)
            high = min(start + n, start + more + (edits - n), length - size)
            for at in range(low, high + 1):
                out.append((other, n, at, size, 3 if more == 0 and at == start else 2))
    return out


def bags(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of lines in a row: character counts in 16 classes, four bits each, modulo 16."""
    kind = ((codes * np.uint32(2654435769)) >> np.uint32(28)).astype(np.int64)
    line = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(line * 16 + kind, minlength=16 * len(sizes)).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
    return (counts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def bag(line: str) -> int:
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(bags(codes, np.array([len(line)]))[0])


def bag_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most twice the edit distance."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for n in range(0, 64, 4):
        x = ((a >> np.uint64(n)) - (b >> np.uint64(n))) & np.uint64(15)
        total += np.minimum(x, np.uint64(16) - x).astype(np.int64)
    return total


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit-parallel, on what common ends leave.

    Columns run along the longer text; it stops as soon as the rest cannot make up for the edits.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    low, n = 0, min(len(a), len(b))
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[len(a) - 1 - high] == b[len(b) - 1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    places: dict[str, int] = {}
    for n, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << n)
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for n, char in enumerate(b):
        match = places.get(char, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = (down | ~(diagonal | up)) & mask, up & diagonal
        score += bool(right & last) - bool(left & last)
        if score - (len(b) - 1 - n) > edits:
            return False
        right = ((right << 1) | 1) & mask
        up, down = ((left << 1) | ~(diagonal | right)) & mask, right & diagonal
    return score <= edits


def stripped(text: str | None) -> list[tuple[int, str]]:
    """Number and text of the lines with a word."""
    return [(n, line) for n, line in enumerate(part.strip(SPACES) for part in (text or "").split("\n")) if line]


def names_of(line: str) -> tuple[int, int]:
    """128 bits of a line as two signed numbers."""
    both = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def _occurrences(docs: DataFrame) -> DataFrame:
    """h_, g_ (the name of a line), doc_ and at_ of every line with a word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g, ids, at = [], [], [], []
            for doc, value in zip(batch.column("doc_").to_pylist(), batch.column("t_")):
                for n, line in stripped(value.as_py()):
                    one, two = names_of(line)
                    h.append(one)
                    g.append(two)
                    ids.append(doc)
                    at.append(n)
            arrays = [pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["h_", "g_", "doc_", "at_"])

    return docs.select("doc_", "t_").mapInArrow(rows, "h_ long, g_ long, doc_ long, at_ int")


def _keys(docs: DataFrame) -> DataFrame:
    """key_, h_, role_ and bag_ of what every line enters and looks up.

    Texts are taken some at a time; a line that comes again among them enters its keys once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, np.ndarray] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                texts = batch.column("t_").slice(begin, TEXTS).to_pylist()
                lines = list(dict.fromkeys(line for text in texts for _, line in stripped(text) if allowed(len(line))))
                if not lines:
                    continue
                sizes = np.fromiter(map(len, lines), np.int64, len(lines))
                codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
                for size in set(sizes.tolist()) - plans.keys():
                    plans[size] = np.array(plan_keys(size), np.int64)
                mine = [plans[size] for size in sizes.tolist()]
                owner = np.repeat(np.arange(len(lines)), [len(p) for p in mine])
                other, segment, start, width, role = np.concatenate(mine).T
                starts = np.cumsum(sizes) - sizes
                hashes = RunHashes(codes.astype(np.uint64)).of(starts[owner] + start, width)
                keys = mix(hashes + (other * 4 + segment).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                names = np.array([names_of(line)[0] for line in lines], np.int64)
                edits = np.minimum(MAX_EDITS, other // CHARS_PER_EDIT)
                arrays = [keys.view(np.int64), names[owner], (role | edits << 2).astype(np.int32), bags(codes, sizes)[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key_", "h_", "role_", "bag_"])

    return docs.select("t_").mapInArrow(rows, "key_ long, h_ long, role_ int, bag_ long")


def _compare(h: np.ndarray, role: np.ndarray, bags: np.ndarray, enter: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different lines, one entered and one asking, whose bags are close enough."""
    close = bag_distance(bags[enter][:, None], bags[ask][None, :]) <= 2 * (role[enter][:, None] >> 2)
    a, b = np.nonzero(close & (h[enter][:, None] != h[ask][None, :]))
    a, b = h[enter[a]], h[ask[b]]
    return np.minimum(a, b), np.maximum(a, b)


def _meet(keys: DataFrame) -> DataFrame:
    """Candidate pairs (kind 0: key_, h_) and the rows of keys with many lines (kind 1), from sorted rows."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key_", "h_", "role_", "bag_"]
        held, many = None, None  # rows of the open key; the key whose rows pass on

        def out(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
            n = len(columns[0])
            arrays = [np.full(n, kind, np.int32), *columns]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind_", *names])

        def groups(rows: dict, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            low, high = [], []
            sizes = np.diff(cuts)
            for k in np.flatnonzero(sizes > 1).tolist():
                h, role = rows["h_"][cuts[k] : cuts[k + 1]], rows["role_"][cuts[k] : cuts[k + 1]]
                if h[0] == h[-1] or not (role & 1).any():  # sorted by h_
                    continue
                bags = rows["bag_"][cuts[k] : cuts[k + 1]].view(np.uint64)
                once = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (role[1:] != role[:-1])]))
                a, b = _compare(h, role, bags, once[(role[once] & 1) > 0], once[(role[once] & 2) > 0])
                low.append(a)
                high.append(b)
            if low:
                both = np.unique(np.stack([np.concatenate(low), np.concatenate(high)]), axis=1)
                if both.shape[1]:
                    nothing = np.zeros(both.shape[1], np.int64)
                    yield out(0, [both[0], both[1], nothing.astype(np.int32), nothing])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
            key = rows["key_"]
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            big = np.diff(cuts) > NODE_LIMIT
            if many is not None and key[0] == many:
                big[0] = True
            for k in np.flatnonzero(big).tolist():
                yield out(1, [rows[c][cuts[k] : cuts[k + 1]] for c in names])
            many = int(key[-1]) if big[-1] else None
            keep = np.flatnonzero(~big[:-1])
            if len(keep):
                at = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in keep[np.diff(cuts)[keep] > 1]] or [np.zeros(0, np.int64)])
                if len(at):
                    some = {c: rows[c][at] for c in names}
                    inner = np.concatenate([[0], np.flatnonzero(some["key_"][1:] != some["key_"][:-1]) + 1, [len(at)]])
                    yield from groups(some, inner)
            held = None if big[-1] else {c: rows[c][cuts[-2] :] for c in names}
        if held is not None:
            yield from groups(held, np.array([0, len(held["key_"])]))

    return keys.select("key_", "h_", "role_", "bag_").mapInArrow(look, "kind_ int, key_ long, h_ long, role_ int, bag_ long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Candidate pairs of keys of any size: every two blocks of a key meet in one group."""
    rows = rows.select("key_", "h_", "role_", "bag_").distinct()
    sizes = rows.groupBy("key_").agg(F.ceil(F.count("*") / F.lit(NODE_LIMIT)).cast("int").alias("b_"))
    placed = rows.join(sizes, "key_").withColumn("at_", F.pmod(F.xxhash64("h_"), F.col("b_")).cast("int"))
    met = placed.withColumn("with_", F.explode(F.sequence(F.lit(0), F.col("b_") - 1))).withColumns(
        {"i_": F.least("at_", "with_"), "j_": F.greatest("at_", "with_")}
    )

    def compare(group: pa.Table) -> pa.Table:
        h, role, at = (group.column(c).to_numpy() for c in ("h_", "role_", "at_"))
        bags, i, j = group.column("bag_").to_numpy().view(np.uint64), group.column("i_")[0].as_py(), group.column("j_")[0].as_py()
        found = []
        for one, two in {(i, j), (j, i)}:
            found.append(_compare(h, role, bags, np.flatnonzero((at == one) & (role & 1 > 0)), np.flatnonzero((at == two) & (role & 2 > 0))))
        return pa.table({"x_": np.concatenate([f[0] for f in found]), "y_": np.concatenate([f[1] for f in found])})

    return met.select("key_", "i_", "j_", "at_", "h_", "role_", "bag_").groupBy("key_", "i_", "j_").applyInArrow(compare, "x_ long, y_ long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of lines (two hashes each) within the allowed edits, from their texts."""
    ids = cut_lineage(pairs.select(F.col("x_").alias("h_")).unionAll(pairs.select(F.col("y_").alias("h_"))).distinct())
    small = ids.count() <= BROADCAST_LINES

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = {line for value in batch.column("t_") for _, line in stripped(value.as_py()) if allowed(len(line))}
            names = [(*names_of(line), line) for line in once]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array([n[2] for n in names], pa.string())],
                names=["h_", "g_", "line_"],
            )

    texts = docs.select("t_").mapInArrow(lines, "h_ long, g_ long, line_ string")
    texts = cut_lineage(texts.join(F.broadcast(ids) if small else ids, "h_", "left_semi").dropDuplicates(["h_", "g_"]))
    one = texts.select(F.col("h_").alias("x_"), F.col("g_").alias("gx_"), F.col("line_").alias("lx_"))
    two = texts.select(F.col("h_").alias("y_"), F.col("g_").alias("gy_"), F.col("line_").alias("ly_"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                within(x, y, allowed(min(len(x), len(y))))
                for x, y in zip(batch.column("lx_").to_pylist(), batch.column("ly_").to_pylist())
            ]
            yield batch.select(["x_", "gx_", "y_", "gy_"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(one, "x_").join(two, "y_").select("x_", "gx_", "lx_", "y_", "gy_", "ly_")
    return met.mapInArrow(check, "x_ long, gx_ long, y_ long, gy_ long")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row: key_, lines_ (lines with a word) and removed_ (numbers of the lines that go, from 0)."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_"), F.col(f"`{text}`").cast("string").alias("t_"))
    known = docs.where("doc_ is not null and t_ is not null")
    met = cut_lineage(_meet(_keys(known).repartition("key_").sortWithinPartitions("key_", "h_", "role_")))
    pairs = met.where("kind_ = 0").select(F.col("key_").alias("x_"), F.col("h_").alias("y_"))
    many = met.where("kind_ = 1")
    if not many.isEmpty():
        pairs = pairs.unionAll(_blocks(many))
    links = cut_lineage(_verified(cut_lineage(pairs.distinct()), known))
    occurrences = cut_lineage(_occurrences(known))
    firsts = cut_lineage(occurrences.groupBy("h_", "g_").agg(F.min(F.struct("doc_", "at_")).alias("first_"), F.count("*").alias("c_")))
    both = links.unionAll(links.select(F.col("y_").alias("x_"), F.col("gy_").alias("gx_"), F.col("x_").alias("y_"), F.col("gx_").alias("gy_")))
    other = both.join(firsts.select(F.col("h_").alias("y_"), F.col("g_").alias("gy_"), "first_"), ["y_", "gy_"])
    near = other.groupBy(F.col("x_").alias("h_"), F.col("gx_").alias("g_")).agg(F.min("first_").alias("near_"))
    # Lines that occur once and have no link lose nothing and are not looked for.
    early = firsts.join(near, ["h_", "g_"], "left").where("c_ > 1 or near_ is not null").select(
        "h_", "g_", F.least("first_", F.coalesce("near_", "first_")).alias("early_")
    )
    gone = occurrences.join(early, ["h_", "g_"]).where(F.struct("doc_", "at_") > F.col("early_"))
    by_doc = gone.groupBy("doc_").agg(F.array_sort(F.collect_set("at_")).alias("removed_"))
    counts = docs.select(
        F.col("doc_").alias("key_"),
        F.size(F.filter(F.split(F.coalesce("t_", F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("lines_"),
    )
    # Rows without an id match nothing and are spread.
    counts = counts.withColumn("j_", F.coalesce("key_", F.monotonically_increasing_id()))
    joined = counts.join(by_doc.withColumnRenamed("doc_", "j_"), "j_", "left")
    empty = F.array().cast("array<int>")
    return joined.select("key_", "lines_", F.when(F.col("key_").isNull(), empty).otherwise(F.coalesce("removed_", empty)).alias("removed_"))


def drop_lines(df: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the lines that ``repeated_lines`` names taken out of its texts."""
    some = removed.where("key_ is not null and size(removed_) > 0").select("key_", "removed_").dropDuplicates(["key_"])
    joined = df.join(some, df[key].cast("long") == some["key_"], "left")
    lines = F.filter(F.split(df[text], "\n"), lambda line, n: ~F.array_contains(some["removed_"], n))
    kept = F.when(some["removed_"].isNull(), df[text]).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[kept.alias(c) if c == text else df[c] for c in df.columns])
