"""Exact Jaccard self-join of word shingle sets with signature trees.

Two sets are linked if 100 |A and B| >= percent |A or B|. The search has three steps, none of which loses a link:

* Forests. Sizes are cut into bands. Linked sets whose larger one is in a band differ in at most H shingles,
  so of H + 1 + E segments of the hash space at least 1 + E hold the same shingles in both. A set has
  a key for every segment that is not empty (and, with more than E empty ones, for those too), so linked
  sets share a key. What hangs together by keys is a tree; the others are linked with nothing.
* First look. Each set is compared with the first one of every key on the shingles themselves. In
  nearly all trees this links everything, and the tree is done.
* Trees. Where sets of one tree are still apart, they are put in the order of what they are linked with and
  of a minwise shingle, and cut into leaves of bounded size; 16 leaves have a node above them, 16 nodes
  another. A node holds the OR of its sets' bitmaps, the range of their sizes, the largest number of
  shingles that share a bit, and the label its sets are linked under if it is one. The dual
  traversal starts with the pairs of uppermost nodes. A pair goes on to its children only if the sizes
  allow a link, the common bits and the slack allow the overlap a link needs, and the nodes are
  not one linked group. Two leaves are compared by their sets' bitmaps under the same
  bound, then on the shingles, and give a link for every two groups that they join, never all pairs.

Shingles are 64-bit hashes. Sets that are equal (by 128 bits) are one set from the start, so copies are never
expanded into pairs. Links are joined to components by large and small stars.

Defined results: NULL texts and texts without words have an empty set and no links; with fewer words than a
shingle, the whole row of words is the one shingle. Rows without an id are not linked. Rows of one id are one
document, linked with themselves. Very long texts give long sets; a leaf holds fewer of them. An empty
table gives an empty table. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.near_duplicates import components
from tableprobe.llm.tables import stored
from tableprobe.llm.words import chain, grams, mix, word_hashes
from tableprobe.session import cut_lineage

BAND = 1.5  # a band ends where sizes are so many times its start
EMPTY_SHARE = 25  # one spare segment for so many
LEAF_SETS, LEAF_BYTES = 1024, 4 << 20
FAN = 16
LEVELS = 3
GROUP = 32  # sets of an inner node of a leaf
PARTNERS = 512  # rows that are compared with one copy of a set
BROADCAST_IDS = 1_000_000


def band_starts(longest: int) -> list[int]:
    """First sizes of the bands up to a size."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def segments(low: int, high: int, percent: int) -> tuple[int, int]:
    """Differences of linked sets whose larger one has a size in [low, high), and spare segments."""
    differences = 2 * (high - 1) * (100 - percent) // (100 + percent)
    return differences, -(-(differences + 1) // EMPTY_SHARE)


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: linked sets that are not equal share one."""
    n, out = len(shingles), []
    starts = band_starts(n * 100 // percent + 1)
    scrambled = mix(shingles + np.uint64(0x5EED))
    for b, low in enumerate(starts[:-1]):
        high = starts[b + 1]
        if n >= high or 100 * n < percent * low:
            continue
        differ, spare = segments(low, high, percent)
        if not differ:
            continue  # equal sets only
        count = differ + 1 + spare
        at = ((scrambled >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        held, sums = at[first], np.add.reduceat(scrambled[order], first)
        if count - len(held) > spare:
            none = np.setdiff1d(np.arange(count, dtype=np.uint64), held)
            held, sums = np.concatenate([held, none]), np.concatenate([sums, np.zeros(len(none), np.uint64)])
        out.append(mix(mix(sums) + mix(held + np.uint64(b << 40))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z in lower case."""
    row = word_hashes(text.encode("utf-8", "surrogatepass").lower().split() if text else [])
    if 0 < len(row) < size:
        return chain([h[None] for h in row])
    return np.unique(grams(row, size))


def described(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """row_, doc_, n_, a_, b_ (hash of the set), keys_ and set_ (the shingles) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                n, a, b, keys, sets = [], [], [], [], []
                for value in part.column("t_"):
                    found = shingle_set(value.as_py(), size)
                    n.append(len(found))
                    a.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(77))).view(np.int64)) if len(found) else 0)
                    keys.append(segment_keys(found, percent).view(np.int64) if len(found) else np.empty(0, np.int64))
                    sets.append(found.tobytes())
                ids = np.arange(number, number + part.num_rows)
                number += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        part.column("doc_"),
                        *[pa.array(x, pa.int64()) for x in (n, a, b)],
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["row_", "doc_", "n_", "a_", "b_", "keys_", "set_"],
                )

    named = df.select(F.col(f"`{key}`").cast("long").alias("doc_"), F.col(f"`{text}`").cast("string").alias("t_"))
    return named.mapInArrow(rows, "row_ long, doc_ long, n_ long, a_ long, b_ long, keys_ array<long>, set_ binary")


def with_sets(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``wanted`` with the set_ of their row_.

    Few are sent to the sets. For many, bitmaps of their numbers (a bit per row) are sent first, so that no set
    is shuffled that nobody asks for.
    """
    sets = rows.select("row_", "set_")
    if wanted.count() <= BROADCAST_IDS:
        return sets.join(F.broadcast(wanted), "row_")
    marks = wanted.groupBy(F.bitmap_bucket_number("row_").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row_")).alias("marks_"))
    place = F.bitmap_bit_position("row_")
    byte = F.conv(F.hex(F.substring("marks_", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = sets.join(F.broadcast(marks), F.bitmap_bucket_number("row_") == F.col("bucket_"))
    marked = marked.where(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1)
    return marked.select("row_", "set_").join(wanted, "row_")


def first_of_key(keyed: DataFrame) -> DataFrame:
    """Pairs (x_, y_) of the smallest row_ of a key_ and its other rows; the keys stream by in order, shuffled once."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, row = batch.column("key_").to_numpy(), batch.column("row_").to_numpy()
            start = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
            x = np.where(at >= 0, row[at], least)
            last, least = key[-1], x[-1]
            other = x != row
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[other]), pa.array(row[other])], names=["x_", "y_"])

    return keyed.repartition("key_").sortWithinPartitions("key_", "row_").mapInArrow(pairs, "x_ long, y_ long")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x_, y_) that are linked, by their shingles.

    The partners of a set stream past one copy of it; a set with many partners has several copies in
    different tasks.
    """
    parts = pairs.groupBy("x_").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts_"))
    placed = pairs.join(parts, "x_").withColumn("at_", F.pmod(F.xxhash64("y_"), F.col("parts_")).cast("int"))
    copies = parts.withColumn("at_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
    wanted = placed.select(F.col("y_").alias("row_"), "x_", "at_", "y_").unionAll(
        copies.select(F.col("x_").alias("row_"), "x_", "at_", F.lit(None).cast("long").alias("y_"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for x, y, raw in zip(batch.column("x_").to_pylist(), batch.column("y_").to_pylist(), batch.column("set_")):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if y is None:
                    mine = other
                    continue
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                both = int((mine[at] == other).sum())
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    found.append((x, y))
            if found:
                x, y = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x_", "y_"])

    streams = with_sets(cut_lineage(wanted), sets).select("x_", "at_", "y_", "set_")
    streams = streams.repartition("x_", "at_").sortWithinPartitions("x_", "at_", F.col("y_").asc_nulls_first())
    return streams.mapInArrow(compare, "x_ long, y_ long")


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` bits per set."""
    out = np.zeros((len(sets), bits), np.uint8)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out[row, (mix(np.concatenate(sets)) >> np.uint64(20)) % np.uint64(bits)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


NODE = "tree_ long, level_ int, node_ long, parent_ long, low_ long, high_ long, slack_ long, label_ long, bits_ binary"
LEAF = ", ids_ array<long>, labels_ array<long>, sizes_ array<long>, sets_ binary"


def nodes_of(rows: DataFrame) -> DataFrame:
    """Leaves and the nodes above them, from rows in order (tree_, row_, label_, n_, bits_n_, set_)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 33, 0
        leaf: list[tuple] = []
        # The nodes that wait for their parent, level by level: (low, high, slack, label, bits).
        waiting: list[list[tuple]] = [[] for _ in range(LEVELS)]
        parents = [0] * LEVELS
        tree, width, held = None, 0, 0
        out: list[dict] = []

        def fresh() -> int:
            nonlocal number
            number += 1
            return base + number - 1

        def add(level: int, low: int, high: int, slack: int, label: int | None, bits: np.ndarray, more: dict) -> None:
            """A finished node: its parent takes it in, and is finished itself once it is full."""
            top = level == LEVELS - 1
            if not top and not waiting[level]:
                parents[level] = fresh()
            node = more.pop("node_", None)
            values = {"tree_": tree, "level_": level, "node_": fresh() if node is None else node, "parent_": None if top else parents[level]}
            out.append({**values, "low_": low, "high_": high, "slack_": slack, "label_": label, "bits_": bits.tobytes(), **more})
            if not top:
                waiting[level].append((low, high, slack, label, bits))
                if len(waiting[level]) == FAN:
                    close(level)

        def close(level: int) -> None:
            low, high, slack, labels, bits = zip(*waiting[level])
            waiting[level] = []
            label = labels[0] if len(set(labels)) == 1 else None
            add(level + 1, min(low), max(high), max(slack), label, np.bitwise_or.reduce(np.stack(bits)), {"node_": parents[level]})

        def flush() -> None:
            nonlocal leaf, held
            if not leaf:
                return
            ids, labels, sizes, raw = zip(*leaf)
            maps = bitmaps([np.frombuffer(x, np.uint64) for x in raw], width)
            slack = int((np.array(sizes) - np.bitwise_count(maps).sum(axis=1)).max())
            label = labels[0] if len(set(labels)) == 1 else None
            more = {"ids_": list(ids), "labels_": list(labels), "sizes_": list(sizes), "sets_": b"".join(raw)}
            leaf, held = [], 0
            add(0, min(sizes), max(sizes), slack, label, np.bitwise_or.reduce(maps), more)

        def end() -> None:
            flush()
            for level in range(LEVELS - 1):
                if waiting[level]:
                    close(level)

        def taken() -> pa.RecordBatch:
            table = pa.Table.from_pylist(out, SCHEMA)
            out.clear()
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree_", "row_", "label_", "n_", "bits_n_")]
            for t, row, label, n, bits, raw in zip(*columns, batch.column("set_")):
                if t != tree:
                    end()
                    tree, width = t, bits
                leaf.append((row, label, n, raw.as_py()))
                held += 8 * n + width // 8
                if len(leaf) >= LEAF_SETS or held >= LEAF_BYTES:
                    flush()
                if len(out) >= 64:
                    yield taken()
        end()
        if out:
            yield taken()

    return rows.select("tree_", "row_", "label_", "n_", "bits_n_", "set_").mapInArrow(build, NODE + LEAF)


SCHEMA = pa.schema(
    [("tree_", pa.int64()), ("level_", pa.int32())]
    + [(c, pa.int64()) for c in ("node_", "parent_", "low_", "high_", "slack_", "label_")]
    + [("bits_", pa.binary())]
    + [(c, pa.list_(pa.int64())) for c in ("ids_", "labels_", "sizes_")]
    + [("sets_", pa.binary())]
)


def traversed(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (i_, j_) of leaves that may hold a link between different labels: i_ <= j_."""

    def pruned(pairs: DataFrame) -> DataFrame:
        """Pairs of nodes whose sizes, labels and largest possible overlap allow a link."""
        sizes = (100 * F.col("x.high_") >= percent * F.col("y.low_")) & (100 * F.col("y.high_") >= percent * F.col("x.low_"))
        apart = ~F.coalesce(F.col("x.label_") == F.col("y.label_"), F.lit(False))
        need = percent * (F.col("x.low_") + F.col("y.low_"))
        spare = F.least("x.slack_", "y.slack_")
        wide = pairs.where(sizes & apart).select(
            F.col("x.node_").alias("i_"), F.col("y.node_").alias("j_"), F.col("x.bits_").alias("p_"), F.col("y.bits_").alias("q_"), need.alias("need_"), spare.alias("spare_")
        )

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                need, spare = (batch.column(c).to_numpy() for c in ("need_", "spare_"))
                common = [
                    int(np.bitwise_count(np.frombuffer(p.as_buffer(), np.uint64) & np.frombuffer(q.as_buffer(), np.uint64)).sum())
                    for p, q in zip(batch.column("p_"), batch.column("q_"))
                ]
                good = pa.array((100 + percent) * (np.array(common, np.int64) + spare) >= need)
                yield batch.select(["i_", "j_"]).filter(good)

        return wide.mapInArrow(bound, "i_ long, j_ long")

    plain = nodes.select("tree_", "level_", "node_", "parent_", "low_", "high_", "slack_", "label_", "bits_")
    top = plain.where(F.col("level_") == LEVELS - 1)
    pairs = pruned(top.alias("x").join(top.alias("y"), (F.col("x.tree_") == F.col("y.tree_")) & (F.col("x.node_") <= F.col("y.node_"))))
    for level in range(LEVELS - 2, -1, -1):
        children = plain.where(F.col("level_") == level)
        down = pairs.join(children.alias("x"), F.col("i_") == F.col("x.parent_")).join(children.alias("y"), F.col("j_") == F.col("y.parent_"))
        pairs = pruned(down.where((F.col("i_") != F.col("j_")) | (F.col("x.node_") <= F.col("y.node_"))))
    return pairs.select(F.least("i_", "j_").alias("i_"), F.greatest("i_", "j_").alias("j_"))


def links_between(
    one: np.ndarray, two: np.ndarray, same: bool, ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Links that join different labels of the sets ``one`` and ``two`` (positions), each by the shingles."""
    n = np.array([len(s) for s in sets], np.int64)
    width = 64 * max(1, int(2 ** np.ceil(np.log2(2 * n.max() / 64))))
    maps = bitmaps(sets, width)
    slack = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    labels, out = labels.copy(), []
    groups = [[side[k : k + GROUP] for k in range(0, len(side), GROUP)] for side in (one, two)]
    facts = [[(np.bitwise_or.reduce(maps[g]), n[g].min(), n[g].max(), slack[g].max()) for g in side] for side in groups]
    for a, (bits, low, high, spare) in zip(groups[0], facts[0]):
        near = []
        for b, (bits2, low2, high2, spare2) in zip(groups[1], facts[1]):
            common = int(np.bitwise_count(bits & bits2).sum())
            if 100 * high >= percent * low2 and 100 * high2 >= percent * low and (100 + percent) * (common + min(spare, spare2)) >= percent * (low + low2):
                near.append(b)
        if not near:
            continue
        other = np.concatenate(near)
        for u in a.tolist():
            v = other[labels[other] != labels[u]]
            if same:
                v = v[v > u]
            v = v[(100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v]))]
            if not len(v):
                continue
            most = np.bitwise_count(maps[u] & maps[v]).sum(axis=1).astype(np.int64) + np.minimum(slack[u], slack[v])
            for w in v[(100 + percent) * most >= percent * (n[u] + n[v])].tolist():
                if labels[w] == labels[u]:
                    continue
                at = np.minimum(np.searchsorted(sets[u], sets[w]), n[u] - 1)
                both = int((sets[u][at] == sets[w]).sum())
                if 100 * both >= percent * (n[u] + n[w] - both):
                    out.append((int(ids[u]), int(ids[w])))
                    labels[labels == labels[w]] = labels[u]
    return out


def compared(leaves: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (x_, y_) of the pairs of leaves; both leaves of a pair meet in one group."""
    sides = pairs.select("i_", "j_", F.col("i_").alias("node_")).unionAll(pairs.where("i_ != j_").select("i_", "j_", F.col("j_").alias("node_")))
    met = sides.join(leaves.select("node_", "ids_", "labels_", "sizes_", "sets_"), "node_")

    def compare(both: pa.Table) -> pa.Table:
        order = np.argsort(both.column("node_").to_numpy())
        ids, labels, sets, ends = [], [], [], []
        for row in order.tolist():
            ids += both.column("ids_")[row].as_py()
            labels += both.column("labels_")[row].as_py()
            sizes = np.cumsum(both.column("sizes_")[row].values.to_numpy())
            sets += np.split(np.frombuffer(both.column("sets_")[row].as_buffer(), np.uint64), sizes[:-1])
            ends.append(len(ids))
        every = np.arange(len(ids))
        one, two = every[: ends[0]], every[ends[0] :] if len(ends) > 1 else every
        found = links_between(one, two, len(ends) == 1, np.array(ids), np.array(labels), sets, percent)
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"x_": pa.array(x, pa.int64()), "y_": pa.array(y, pa.int64())})

    return met.groupBy("i_", "j_").applyInArrow(compare, "x_ long, y_ long")


def with_label(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows with the component of row_ as ``name``, itself where nothing is linked."""
    return rows.join(known.select(F.col("rep_").alias("row_"), F.col("comp_").alias(name)), "row_", "left").withColumn(name, F.coalesce(name, "row_"))


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """Every row: key_, n_shingles_ and component_, the smallest id reachable by links."""
    rows = stored(described(df, key, text, size, percent), "signatures")
    full = rows.where("n_ > 0 and doc_ is not null")
    equal = stored(full.groupBy("a_", "b_").agg(F.min("row_").alias("row_"), F.min("doc_").alias("least_"), F.count("*").alias("c_")), "signatures")
    copies = equal.where("c_ > 1").select("a_", "b_", F.col("row_").alias("first_"))
    # Of equal sets the first row is searched for; few copies are sent to the rows.
    few = copies.count() <= BROADCAST_IDS
    sets = full.join(F.broadcast(copies) if few else copies, ["a_", "b_"], "left").where("first_ is null or row_ = first_")
    keyed = sets.select(F.explode("keys_").alias("key_"), "row_")
    pairs = stored(first_of_key(keyed).distinct(), "signatures")
    links = stored(linked_pairs(pairs, rows, percent), "signatures")
    # Several sets of one id are one document.
    several = full.groupBy("doc_").agg(F.min("a_").alias("m_"), F.max("a_").alias("n_")).where("m_ != n_").select("doc_")
    own = full.join(several, "doc_").join(equal.select("a_", "b_", F.col("row_").alias("y_")), ["a_", "b_"])
    first = own.groupBy("doc_").agg(F.min("y_").alias("x_"))
    own = own.join(first, "doc_").where("x_ != y_").select("x_", "y_").distinct()
    links = stored(links.unionAll(own), "signatures")
    known = cut_lineage(components(links))
    trees = cut_lineage(components(pairs))
    members = with_label(trees.select(F.col("rep_").alias("row_"), F.col("comp_").alias("tree_")), known, "label_")
    apart = members.groupBy("tree_").agg(F.min("label_").alias("m_"), F.max("label_").alias("n_")).where("m_ != n_").select("tree_")
    open_ = cut_lineage(members.join(apart, "tree_"))
    if not open_.isEmpty():
        here = rows.select("row_", "n_").join(open_, "row_")
        most = here.groupBy("tree_").agg(F.pow(F.lit(2), F.ceil(F.log2(F.max("n_") * 2))).cast("long").alias("bits_n_"))
        here = here.join(most.withColumn("bits_n_", F.greatest("bits_n_", F.lit(64))), "tree_")
        here = with_sets(cut_lineage(here), rows)
        order = here.withColumn("order_", F.xxhash64(F.substring("set_", 1, 8)))  # the smallest shingle hash
        order = order.repartitionByRange("tree_", "label_", "order_", "row_").sortWithinPartitions("tree_", "label_", "order_", "row_")
        nodes = stored(nodes_of(order), "signatures")
        leaves = nodes.where("level_ = 0")
        more = stored(compared(leaves, stored(traversed(nodes, percent), "signatures"), percent), "signatures")
        known = cut_lineage(components(links.unionAll(more)))
    ends = with_label(equal.select("row_", "a_", "b_", "least_"), known, "comp_")
    least = ends.groupBy("comp_").agg(F.min("least_").alias("component_"))
    placed = ends.join(least, "comp_").select("a_", "b_", "component_")
    # Rows without a set or an id match nothing; they are spread by their number.
    real = (F.col("n_") > 0) & F.col("doc_").isNotNull()
    out = rows.select("doc_", "n_", F.when(real, F.col("a_")).otherwise(F.col("row_")).alias("a_"), F.when(real, F.col("b_")).alias("b_"))
    return out.join(placed, ["a_", "b_"], "left").select(
        F.col("doc_").alias("key_"), F.col("n_").alias("n_shingles_"), F.coalesce("component_", "doc_").alias("component_")
    )
