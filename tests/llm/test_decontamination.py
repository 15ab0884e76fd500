import numpy as np
import pytest

from tableprobe.llm.decontamination import clean, contaminated, overlaps, tiles, tokens
from tableprobe.llm.queries import QUERIES

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def brute_tiles(doc, item, minimum):
    """Greedy string tiling as it is defined: look at all pairs of positions in every round."""
    doc_used, item_used, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (
                    i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                    and i + n not in item_used and d + n not in doc_used
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < minimum:
            return out
        out.append((i, d, n))
        item_used |= set(range(i, i + n))
        doc_used |= set(range(d, d + n))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_like_brute_force(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint64)
    parts = [rng.integers(0, 12, rng.integers(0, 9)).astype(np.uint64)]
    for _ in range(4):
        a = rng.integers(0, len(item))
        parts += [item[a : a + rng.integers(1, 15)], rng.integers(0, 12, 3).astype(np.uint64)]
    doc = np.concatenate(parts)
    got = tiles(doc, item, 3)
    want = brute_tiles(doc.tolist(), item.tolist(), 3)
    for i, d, n in got:
        assert (item[i : i + n] == doc[d : d + n]).all() and n >= 3
    assert len({k for i, _, n in got for k in range(i, i + n)}) == sum(n for *_, n in got)
    # Ties between equally long matches may be taken in another order; what is longest is not.
    assert max((n for *_, n in got), default=0) == max((n for *_, n in want), default=0)
    assert abs(sum(n for *_, n in got) - sum(n for *_, n in want)) <= 6


def frames(spark):
    words = ITEM.split()
    moved = " ".join(words[8:] + ["between"] + words[:8])
    rows = [
        (1, f"before {ITEM.upper()}, after", "x", 0.5),
        (2, moved, "x", 0.5),
        (3, "nothing of the kind", "x", 0.5),
        (4, " ".join(words[:6]), "x", 0.5),
        (None, ITEM, "x", 0.5),
        (5, None, None, None),
        (6, "", "x", 0.5),
        (7, "yes " * 50_000, "x", 0.5),
        (1, f"before {ITEM.upper()}, after", "x", 0.5),
        (8, "tiny item", "x", 0.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, coverage double")
    items = spark.createDataFrame([(10, ITEM), (11, "tiny item"), (12, None), (None, "x y z"), (13, "")], "item_id long, text string")
    return docs, items


@pytest.mark.parametrize("block_tokens", [10, 2_000_000])
def test_pairs_and_clean_rows(spark, block_tokens):
    docs, items = frames(spark)
    pairs = overlaps(docs, items, block_tokens=block_tokens)
    found = sorted((r.key_ or -1, r.item_) for r in contaminated(pairs).collect())
    assert found == [(-1, 10), (1, 10), (1, 10), (2, 10), (8, 11)]
    assert {r.key_: r.tiled for r in pairs.collect()}[4] == 6
    kept = clean(docs, items, block_tokens=block_tokens)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert overlaps(docs.limit(0), items).count() == 0
    assert overlaps(docs, items.limit(0)).count() == 0
    assert clean(docs, items.limit(0)).count() == docs.count()


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    want = set()
    for doc in docs:
        d = tokens(doc.text)
        have = set(zip(*(d[k:] for k in range(5))))
        for item in items:
            i = tokens(item.text)
            if have & set(zip(*(i[k:] for k in range(5)))) and sum(n for *_, n in brute_tiles(d, i, 3)) >= 0.7 * len(i):
                want.add((doc.doc_id, item.item_id))
    assert got == want and want
