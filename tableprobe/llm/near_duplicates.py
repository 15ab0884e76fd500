"""Near-duplicate documents: a chosen-path set similarity join.

A document is the set of its word shingles. Independent trees branch the documents: each level of
a tree has a hash function, and a document goes on to the child named by its minwise token under
it. Two documents of similarity s take the same step with probability s, so a node at depth d
holds both with probability s^d, and ``trees`` of them miss a pair with (1 - s^d)^trees: 5.9e-7
for s = 0.8, d = 3 and 20 trees, and far less for closer pairs. All nodes are at depth 3, whatever
their size, so the chance is the same in groups of any size.

Sets that are equal are joined first, by a 128-bit hash; one of them (the smallest id) stands for
all. In a node of a few sets all are compared; in a larger one all with the first and each with
the next. What this links is checked on the full sets and joined to components. Then nodes that
still hold sets of different components are compared exhaustively across components: sets already
known to hang together need no comparison, so a group of thousands of near copies does not cost
the square of its size. Large nodes are compared in pairs of blocks, each in a task of its own:
the sets outside the node's most frequent component with all sets of the node.

The first check also tells in which shingles a set differs from the one it was compared with. If
two sets differ from the same set p in nothing they share, each is at least as close to p as to
the other, so a link between them means links of both to p. Second comparisons therefore ask,
of sets with the same p, for enough shared differences; random edits have none.

A comparison looks at sizes and at a 256-bit sketch first (one bit of 256 minwise hashes). It
passes pairs from an estimate of about 0.6 on; a pair of similarity 0.8 fails that with a chance
below one in a million. Every link is confirmed on the full sets of 64-bit shingle hashes, which are stored
once and read for candidates only; no text is read twice.

Defined results: NULL texts and texts without words have an empty set and no links; with fewer
words than a shingle, the whole row of words is the one shingle. Rows without an id are not
linked. Rows of one id are one document: the one with the smallest set hash stands for it. An empty table gives an empty table. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.batches import copied, tidy
from tableprobe.llm.tables import stored
from tableprobe.llm.words import chain, grams, mix, word_hashes
from tableprobe.session import cut_lineage

TREES = 20
DEPTH = 3  # nodes above it hold nearly everything; those below miss more pairs
SKETCH_BITS = 256
MIN_EQUAL_BITS = 206  # expected at a similarity of 0.8: 230, with a deviation of 4.8
SMALL_NODE = 4
NODE_LIMIT = 512
BLOCK_NODES = 4  # a block of a larger node holds about so many times NODE_LIMIT sets
PAIRS_AT_ONCE = 1 << 18
BROADCAST_IDS = 2_000_000
ROWS_AT_ONCE = 128  # rows that a task turns into sets and gives back together
PARTNERS = 512  # sets that are compared with one copy of another
DIFFERENCE_COLUMNS = 2048  # differences that are compared at a time
MASKS, FACTORS = np.random.default_rng(20).integers(0, 2**32, (2, TREES * DEPTH + SKETCH_BITS), dtype=np.uint32)
FACTORS = FACTORS | np.uint32(1)


def words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split cuts at the same six characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a row of word hashes."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < size:
        return chain([h[None] for h in hashes])
    return np.unique(grams(hashes, size))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest scrambled hash of a set under each hash function (32 bits are enough)."""
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.empty(len(MASKS), np.uint32)
    step = max(1, 1_000_000 // len(x))
    for at in range(0, len(MASKS), step):
        some = slice(at, at + step)
        out[some] = ((x[None, :] ^ MASKS[some, None]) * FACTORS[some, None]).min(axis=1)
    return out


def describe(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node names by tree, and the sketch, of a non-empty set."""
    least = mix(minwise(shingles).astype(np.uint64) + np.arange(len(MASKS), dtype=np.uint64) * np.uint64(1 << 32))
    tokens = least[: TREES * DEPTH].reshape(TREES, DEPTH)
    name = mix(np.arange(1, TREES + 1, dtype=np.uint64))
    for level in range(DEPTH):
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + tokens[:, level])
    bits = (least[TREES * DEPTH :] >> np.uint64(17)) & np.uint64(1)
    return name, np.packbits(bits.astype(np.uint8)).view(np.uint64)


def similar(n: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows a and b may reach the threshold, by sizes and sketches."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    same = SKETCH_BITS - np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
    return (small >= threshold * large) & (same >= MIN_EQUAL_BITS)


def sketches(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, SKETCH_BITS // 64)


def describe_rows(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """doc_, n_, the hash of the set (a_, b_), nodes_ (one per tree), sk_ and set_ (sorted hashes) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in copied(batches, ROWS_AT_ONCE):
            n, a, b, nodes, sk, sets = [], [], [], [], [], []
            for value in batch.column("t_"):
                found = shingle_hashes(word_hashes(words(value.as_py())), size)
                n.append(len(found))
                sets.append(found.tobytes())
                if len(found):
                    node, sketch = describe(found)
                    a.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(77))).view(np.int64)))
                    nodes.append(node.view(np.int64))
                    sk.append(sketch.tobytes())
                else:
                    a.append(None)
                    b.append(None)
                    nodes.append(None)
                    sk.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_"),
                    pa.array(n, pa.int64()),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(nodes, pa.list_(pa.int64())),
                    pa.array(sk, pa.binary()),
                    pa.array(sets, pa.binary()),
                ],
                names=["doc_", "n_", "a_", "b_", "nodes_", "sk_", "set_"],
            )

    named = df.select(F.col(f"`{key}`").cast("long").alias("doc_"), F.col(f"`{text}`").cast("string").alias("t_"))
    return named.mapInArrow(tidy(rows), "doc_ long, n_ long, a_ long, b_ long, nodes_ array<long>, sk_ binary, set_ binary")


def _first_look(nodes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of nodes in the order of their sets, and the members of nodes that stay open.

    Rows stream by. A node of up to SMALL_NODE sets is compared whole, a larger one with its first
    set and each with the next; its rows come out again (``kind_`` 1) for the second look.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row and up to SMALL_NODE last ones of the open node, with their places
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            fresh_from = 0
            place0 = np.zeros(0, np.int64)
            if held is not None:
                rows, place0 = held
                fresh_from = len(place0)
                now = pa.concat_tables([rows, now]).combine_chunks()
            node = now.column("node_").to_numpy()
            rep, n = now.column("rep_").to_numpy(), now.column("n_").to_numpy()
            sk = sketches(now.column("sk_"))
            total = len(node)
            start = np.concatenate([[True], node[1:] != node[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(total), 0))
            place = np.arange(total) - first
            if fresh_from and len(place0) > 1:
                # Rows between the held first one and the held last ones were left out.
                place += np.where(node == node[0], np.where(np.arange(total) >= 1, place0[-1] - (fresh_from - 1), 0), 0)
                place[:fresh_from] = place0
            fresh = np.arange(total) >= fresh_from
            pairs = []
            for back in range(1, SMALL_NODE):
                b = np.flatnonzero(fresh & (np.arange(total) - back >= first) & ((back == 1) | (place < SMALL_NODE)))
                pairs.append((b - back, b))
            b = np.flatnonzero(fresh & (place >= SMALL_NODE))
            pairs.append((first[b], b))
            left, right = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            ok = similar(n, sk, left, right, threshold) & (rep[left] != rep[right])
            left, right = left[ok], right[ok]
            low, high = np.minimum(rep[left], rep[right]), np.maximum(rep[left], rep[right])
            both = np.unique(np.stack([low, high]), axis=1)
            # Members of larger nodes: from the row that makes the node larger on, with those before it.
            grows = fresh & (place == SMALL_NODE)
            again = fresh & (place >= SMALL_NODE)
            for back in range(1, SMALL_NODE + 1):
                at = np.flatnonzero(grows) - back
                again[at[at >= 0]] = True
            again = np.flatnonzero(again)
            empty = pa.nulls(both.shape[1])
            found = pa.table(
                {
                    "kind_": pa.array(np.zeros(both.shape[1], np.int32)),
                    "node_": pa.array(both[0]),
                    "rep_": pa.array(both[1]),
                    "n_": empty.cast(pa.int64()),
                    "sk_": empty.cast(pa.binary()),
                }
            )
            members = now.take(pa.array(again)).select(["node_", "rep_", "n_", "sk_"])
            members = members.add_column(0, "kind_", pa.array(np.ones(len(again), np.int32)))
            for table in (found, members):
                yield from table.cast(OUT).combine_chunks().to_batches()
            tail = np.flatnonzero(first == first[-1])
            keep = np.unique(np.concatenate([tail[:1], tail[-SMALL_NODE:]]))
            held = (now.take(pa.array(keep)), place[keep])

    columns = ["node_", "rep_", "n_", "sk_"]
    return nodes.select(*columns).mapInArrow(tidy(look), "kind_ int, node_ long, rep_ long, n_ long, sk_ binary")


def shared_differences(pivot: np.ndarray, differences: pa.Array, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows a and b may be linked, by what both differ in from the same pivot.

    With s = (1 - t) / (1 + t), a link needs |A - B| + |B - A| <= s (|A| + |B|), and that symmetric
    difference is the sum of both differences less twice what they share.
    """
    ok = np.ones(len(a), bool)
    same = np.flatnonzero(pivot[a] == pivot[b])
    if not len(same):
        return ok
    a, b = a[same], b[same]
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    some = differences.take(pa.array(rows))
    length = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), length)
    # Only differences that several rows have can be shared.
    names, place, count = np.unique(some.flatten().to_numpy(), return_inverse=True, return_counts=True)
    common = count[place] > 1
    row, (columns, place) = row[common], np.unique(place[common], return_inverse=True)
    left, i = np.unique(at[: len(a)], return_inverse=True)
    right, j = np.unique(at[len(a) :], return_inverse=True)
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(columns), DIFFERENCE_COLUMNS):
        mine = (place >= first) & (place < first + DIFFERENCE_COLUMNS)
        table = np.zeros((len(rows), min(DIFFERENCE_COLUMNS, len(columns) - first)), np.float32)
        table[row[mine], place[mine] - first] = 1
        both += table[left] @ table[right].T
    s = (1 - threshold) / (1 + threshold)
    ok[same] = length[at[: len(a)]] + length[at[len(a) :]] - 2 * both[i, j] <= s * (n[a] + n[b]) + 1e-6
    return ok


OUT = pa.schema(
    [
        ("kind_", pa.int32()),
        ("node_", pa.int64()),
        ("rep_", pa.int64()),
        ("n_", pa.int64()),
        ("sk_", pa.binary()),
    ]
)


def _second_look(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes in order, compared across components.

    Comes out: pairs (kind 0) of nodes of up to NODE_LIMIT sets with two components or more, and
    the rows (kind 1) of larger nodes, for the comparison in blocks.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the open node, up to NODE_LIMIT
        large = False  # the open node is larger: its rows pass on

        def compare(rows: pa.Table) -> pa.Table:
            label, rep = rows.column("label_").to_numpy(), rows.column("rep_").to_numpy()
            n, sk = rows.column("n_").to_numpy(), sketches(rows.column("sk_"))
            a, b = np.nonzero(label[:, None] < label[None, :])
            ok = np.flatnonzero(similar(n, sk, a, b, threshold))
            ok = ok[shared_differences(rows.column("p_").to_numpy(), rows.column("d_").combine_chunks(), n, a[ok], b[ok], threshold)]
            low, high = np.minimum(rep[a[ok]], rep[b[ok]]), np.maximum(rep[a[ok]], rep[b[ok]])
            nothing = pa.nulls(len(low))
            return pa.table(
                {
                    "kind_": pa.array(np.zeros(len(low), np.int32)),
                    "node_": pa.array(low),
                    "rep_": pa.array(high),
                    "n_": nothing.cast(pa.int64()),
                    "sk_": nothing.cast(pa.binary()),
                }
            ).cast(OUT)

        def onward(rows: pa.Table) -> pa.Table:
            rows = rows.select(["node_", "rep_", "n_", "sk_"])
            return rows.add_column(0, "kind_", pa.array(np.ones(rows.num_rows, np.int32))).cast(OUT)

        def finish(rows: pa.Table) -> pa.Table | None:
            if large or rows is None or rows.num_rows < 2 or len(np.unique(rows.column("label_").to_numpy())) < 2:
                return None
            return compare(rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                now = pa.concat_tables([held, now]).combine_chunks()
            node = now.column("node_").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            for k in range(len(cuts) - 1):
                rows = now.slice(int(cuts[k]), int(cuts[k + 1] - cuts[k]))
                if k:
                    large = False
                elif large and held_node != node[0]:
                    large = False
                open_ = k == len(cuts) - 2
                if large or rows.num_rows > NODE_LIMIT:
                    large = True
                    yield from onward(rows).combine_chunks().to_batches()
                    rows = rows.slice(0, 0)
                elif not open_:
                    out = finish(rows)
                    if out is not None:
                        yield from out.combine_chunks().to_batches()
                if open_:
                    held, held_node = rows, int(node[-1])
        out = finish(held)
        if out is not None:
            yield from out.combine_chunks().to_batches()

    columns = ["node_", "rep_", "n_", "sk_", "label_", "p_", "d_"]
    return nodes.select(*columns).mapInArrow(tidy(look), "kind_ int, node_ long, rep_ long, n_ long, sk_ binary")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of nodes with several components, with the block of each (``at_``).

    The most frequent component of a node is not compared with itself. Its rows are in the ``q_``
    blocks from ``r_`` on, all others in those below.
    """
    block = BLOCK_NODES * NODE_LIMIT
    count = rows.groupBy("node_", "label_").agg(F.count("*").alias("c_"))
    sizes = count.groupBy("node_").agg(F.max(F.struct("c_", "label_")).alias("m_"), F.sum("c_").alias("c_")).where("c_ > m_.c_")
    blocks = [F.ceil(c / F.lit(block)).cast("int") for c in (F.col("c_") - F.col("m_.c_"), F.col("m_.c_"))]
    sizes = sizes.select("node_", F.col("m_.label_").alias("main_"), blocks[0].alias("r_"), blocks[1].alias("q_"))
    spread = F.xxhash64("rep_")
    at = F.when(F.col("label_") == F.col("main_"), F.col("r_") + F.pmod(spread, F.col("q_"))).otherwise(F.pmod(spread, F.col("r_")))
    return rows.join(sizes, "node_").withColumn("at_", at.cast("int")).drop("main_")


def _blocks(placed: DataFrame, threshold: float) -> DataFrame:
    """Pairs across components of nodes of any size: every two blocks of a node, one of them below ``r_``, meet in one group."""
    end = F.when(F.col("at_") < F.col("r_"), F.col("r_") + F.col("q_")).otherwise(F.col("r_"))
    met = placed.withColumn("with_", F.explode(F.sequence(F.lit(0), end - 1))).withColumns(
        {"i_": F.least("at_", "with_"), "j_": F.greatest("at_", "with_")}
    )

    def compare(batch: pa.Table) -> pa.Table:
        label, rep = batch.column("label_").to_numpy(), batch.column("rep_").to_numpy()
        at, i, j = batch.column("at_").to_numpy(), batch.column("i_")[0].as_py(), batch.column("j_")[0].as_py()
        n, sk = batch.column("n_").to_numpy(), sketches(batch.column("sk_"))
        one, two = np.flatnonzero(at == i), np.flatnonzero(at == j)
        found = [np.zeros((2, 0), np.int64)]
        step = max(1, PAIRS_AT_ONCE // max(1, len(two)))
        for k in range(0, len(one), step):
            some = one[k : k + step]
            a, b = np.nonzero(label[some][:, None] != label[two][None, :])
            a, b = some[a], two[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            ok = similar(n, sk, a, b, threshold)
            found.append(np.stack([a[ok], b[ok]]))
        a, b = np.concatenate(found, axis=1)
        ok = shared_differences(batch.column("p_").to_numpy(), batch.column("d_").combine_chunks(), n, a, b, threshold)
        a, b = rep[a[ok]], rep[b[ok]]
        return pa.table({"x_": pa.array(np.minimum(a, b), pa.int64()), "y_": pa.array(np.maximum(a, b), pa.int64())})

    columns = ["node_", "i_", "j_", "at_", "rep_", "n_", "sk_", "label_", "p_", "d_"]
    return met.select(*columns).groupBy("node_", "i_", "j_").applyInArrow(compare, "x_ long, y_ long")


def confirm(pairs: DataFrame, rows: DataFrame, searched: DataFrame, percent: int) -> DataFrame:
    """All pairs (x_, y_) with ``linked_``, whether their full sets reach the similarity.

    ``d_`` has the shingles in which y_ differs from x_. ``rows`` has set_ by (doc_, a_, b_) and ``searched`` names
    those three once per id. The partners of a set stream past one copy of it; a set with many partners has several copies in different tasks.
    """
    ids = cut_lineage(pairs.select(F.col("x_").alias("doc_")).unionAll(pairs.select(F.col("y_").alias("doc_"))).distinct())
    # Few ids are sent to the sets; many are joined by a shuffle.
    small = ids.count() <= BROADCAST_IDS
    held = rows.select("doc_", "a_", "b_", "set_").join(F.broadcast(ids) if small else ids, "doc_", "left_semi")
    held = held.join(searched, ["doc_", "a_", "b_"], "left_semi").dropDuplicates(["doc_"]).select("doc_", "set_")
    parts = pairs.groupBy("x_").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts_"))
    placed = pairs.join(parts, "x_").withColumn("at_", F.pmod(F.xxhash64("y_"), F.col("parts_")).cast("int"))
    partners = placed.join(held.withColumnRenamed("doc_", "y_"), "y_").select("x_", "at_", "y_", "set_")
    copies = parts.withColumn("at_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
    copies = copies.join(held.withColumnRenamed("doc_", "x_"), "x_").select("x_", "at_", F.lit(None).cast("long").alias("y_"), "set_")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            x_, y_, linked, differ = [], [], [], []
            for x, y, raw in zip(batch.column("x_").to_pylist(), batch.column("y_").to_pylist(), batch.column("set_")):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if y is None:
                    mine = other
                    continue
                apart = np.setxor1d(mine, other, assume_unique=True)
                union = (len(mine) + len(other) + len(apart)) // 2
                x_.append(x)
                y_.append(y)
                linked.append(100 * (union - len(apart)) >= percent * union)
                differ.append(apart.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x_, pa.int64()), pa.array(y_, pa.int64()), pa.array(linked, pa.bool_()), pa.array(differ, pa.list_(pa.int64()))],
                names=["x_", "y_", "linked_", "d_"],
            )

    streams = partners.unionAll(copies).repartition("x_", "at_").sortWithinPartitions("x_", "at_", F.col("y_").asc_nulls_first())
    return streams.mapInArrow(tidy(check), "x_ long, y_ long, linked_ boolean, d_ array<long>")


def shingles(text: str | None, size: int) -> set:
    """The exact set of shingles."""
    w = words(text)
    return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else ({tuple(w)} if w else set())


def _checksum(edges: DataFrame) -> tuple:
    """Number of links and sums of their hashes, to tell whether a round has changed anything."""
    hashes = [F.xxhash64("low", "high", F.lit(seed)).cast("decimal(20,0)") for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *[F.sum(h) for h in hashes]).first())


def components(edges: DataFrame) -> DataFrame:
    """rep_ and comp_ (the smallest id reachable) of all ends of ``edges`` (x_, y_).

    Large and small stars in turn: each node links its larger neighbours, then its smaller ones,
    to the smallest of them, until every node hangs on the smallest of its component. The links
    at a node are grouped as a minimum and a join, never as a list.
    """
    now = cut_lineage(edges.where("x_ != y_").select(F.least("x_", "y_").alias("low"), F.greatest("x_", "y_").alias("high")).distinct())
    mark = _checksum(now)
    while True:
        both = now.unionAll(now.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        star = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low != high").distinct()
        down = star.groupBy("high").agg(F.min("low").alias("m"))
        up = star.join(down, "high").select(F.col("m").alias("low"), F.when(F.col("low") == F.col("m"), F.col("high")).otherwise(F.col("low")).alias("high"))
        now = cut_lineage(up.where("low != high").distinct())
        before, mark = mark, _checksum(now)
        if mark == before:
            break
    ends = now.groupBy(F.col("high").alias("rep_")).agg(F.min("low").alias("comp_"))
    return ends.unionAll(ends.select(F.col("comp_").alias("rep_"), "comp_").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Every row: key_, n_shingles_ and component_ (smallest linked id)."""
    threshold = percent / 100
    rows = stored(describe_rows(df, key, text, size), "near-duplicates")
    full = rows.where("n_ > 0 and doc_ is not null")
    one = full.groupBy("doc_").agg(F.min(F.struct("a_", "b_")).alias("s_")).select("doc_", "s_.a_", "s_.b_")
    sets = one.groupBy("a_", "b_").agg(F.min("doc_").alias("rep_"))
    searched = sets.select(F.col("rep_").alias("doc_"), "a_", "b_")
    reps = full.join(searched, ["doc_", "a_", "b_"], "left_semi").dropDuplicates(["doc_"])
    nodes = reps.select(F.explode("nodes_").alias("node_"), F.col("doc_").alias("rep_"), "n_", "sk_")

    def in_order(x: DataFrame) -> DataFrame:
        return x.repartition("node_").sortWithinPartitions("node_", "rep_")

    seen = cut_lineage(_first_look(in_order(nodes), threshold))
    pairs = seen.where("kind_ = 0").select(F.col("node_").alias("x_"), F.col("rep_").alias("y_")).distinct()
    checked = stored(confirm(cut_lineage(pairs), full, searched, percent), "near-duplicates")
    links = [checked.where("linked_").select("x_", "y_").distinct()]
    apart = checked.groupBy(F.col("y_").alias("rep_")).agg(F.min_by("d_", "x_").alias("d_"), F.min("x_").alias("p_"))

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows with their component so far."""
        return rows.join(known, "rep_", "left").withColumn("label_", F.coalesce("comp_", "rep_")).drop("comp_")

    def differing(rows: DataFrame) -> DataFrame:
        """Rows with their difference from a set with a smaller id."""
        out = rows.join(apart, "rep_", "left")
        return out.withColumns({"p_": F.coalesce("p_", "rep_"), "d_": F.coalesce("d_", F.array().cast("array<long>"))})

    known = cut_lineage(components(links[0]))
    open_ = seen.where("kind_ = 1").select("node_", "rep_", "n_", "sk_")
    if not open_.isEmpty():
        seen = cut_lineage(_second_look(in_order(differing(labelled(open_))), threshold))
        more = seen.where("kind_ = 0").select(F.col("node_").alias("x_"), F.col("rep_").alias("y_"))
        large = seen.where("kind_ = 1").select("node_", "rep_", "n_", "sk_")
        if not large.isEmpty():
            more = more.unionAll(_blocks(differing(cut_lineage(_placed(labelled(large)))), threshold))
        more = cut_lineage(more.distinct())
        if not more.isEmpty():
            links.append(cut_lineage(confirm(more, full, searched, percent).where("linked_").select("x_", "y_").distinct()))
            known = cut_lineage(components(reduce(DataFrame.unionAll, links)))
    member = one.join(sets, ["a_", "b_"]).select("doc_", "rep_").join(known, "rep_", "left")
    member = member.select("doc_", F.coalesce("comp_", "rep_").alias("component_"))
    # Rows without an id or a set match nothing below and are spread by their size.
    linked = F.when(F.col("n_") > 0, F.col("doc_"))
    spread = F.coalesce(linked, -F.abs(F.xxhash64("doc_", "n_", F.monotonically_increasing_id())) - 1)
    return (
        rows.select(F.col("doc_").alias("key_"), "n_", F.when(linked.isNull(), F.lit(0)).otherwise(F.lit(1)).alias("has_"), spread.alias("j_"))
        .join(member.select(F.col("doc_").alias("j_"), F.lit(1).alias("has_"), "component_"), ["j_", "has_"], "left")
        .select("key_", F.col("n_").alias("n_shingles_"), F.coalesce("component_", "key_").alias("component_"))
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, with all their columns.

    Of rows with the same id one stays, as with other copies; rows without an id or without words
    stay, for nothing is linked to them. Only the ids of rows that go are sent to the texts.
    """
    found = cut_lineage(near_duplicates(df, key, text, size, percent))
    gone = found.where("key_ != component_").select(F.col("key_").alias("gone_")).distinct()
    small = gone.count() <= BROADCAST_IDS
    kept = df.join(F.broadcast(gone) if small else gone, df[key].cast("long") == gone["gone_"], "left_anti")
    twice = found.where("key_ = component_ and n_shingles_ > 0").groupBy("key_").agg(F.count("*").alias("c")).where("c > 1")
    if twice.isEmpty():
        return kept
    ids = twice.select(F.col("key_").alias("twice_"))
    several = kept.join(ids, kept[key].cast("long") == ids["twice_"], "left_semi")
    return kept.join(ids, kept[key].cast("long") == ids["twice_"], "left_anti").unionByName(several.dropDuplicates([key]))
