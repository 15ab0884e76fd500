import numpy as np
import pytest

from tableprobe.llm.near_duplicates import components, near_duplicates, shingles
from tableprobe.llm import near_duplicates as module
from tableprobe.llm.queries import QUERIES


def brute(rows, size, percent):
    """(id, set size, component) from all pairs that share a shingle."""
    sets = {key: shingles(text, size) for key, text in rows}
    root = {key: key for key in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by = {}
    for key, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(key)
    for a in sets:
        if not sets[a]:
            continue
        shared = {}
        for x in sets[a]:
            for b in by[x]:
                if b > a:
                    shared[b] = shared.get(b, 0) + 1
        for b, both in shared.items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((key, len(s), find(key)) for key, s in sets.items())


def run(spark, rows, size=2, percent=80):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_ int")
    return sorted((r.key_, r.n_shingles_, r.component_) for r in near_duplicates(docs, size=size, percent=percent).collect())


def copies(rng, base, count, edits):
    for _ in range(count):
        text = list(base)
        for at in rng.integers(0, len(text), rng.integers(0, edits + 1)):
            text[at] = f"new{rng.integers(1_000_000)}"
        yield " ".join(text)


@pytest.mark.parametrize("limit", [512, 8])
def test_groups_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "NODE_LIMIT", limit)
    rng = np.random.default_rng(limit)
    pool = [f"w{n}" for n in range(4000)]
    texts = []
    for count, edits, length in [(2, 3, 60), (3, 2, 40), (40, 4, 80), (150, 6, 100), (60, 12, 120), (5, 1, 12)]:
        texts += list(copies(rng, list(rng.choice(pool, length)), count, edits))
    texts += [" ".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(100)]
    texts += [texts[0], texts[0], "one", "ONE", "one ", "", "\n", "a b", "A  b", "x " * 30_000, "x x"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts)]
    assert run(spark, rows) == brute(rows, 2, 80)


def test_copies_far_apart_around_a_late_hub(spark):
    """2 000 different copies, each linked (0.802) to the set with the largest id alone, share nodes of any depth."""
    rng = np.random.default_rng(3)
    base = [f"w{n}" for n in range(201)]
    rows = [(2000, " ".join(base))]
    for key in range(2000):
        text = list(base)
        for at in 3 + 15 * rng.permutation(13)[:11] + rng.integers(0, 12, 11):
            text[at] = f"new{key}-{at}"
        rows.append((key, " ".join(text)))
    assert {r[2] for r in run(spark, rows)} == {0}


@pytest.mark.parametrize("limit", [2, 5])
def test_blocks_of_mixed_components_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "NODE_LIMIT", limit)
    rng = np.random.default_rng(limit)
    core = [f"c{n}" for n in range(90)]
    texts = []
    for group in range(12):  # groups share 90 of about 103 words, so their nodes mix components
        base = core + [f"g{group}-{n}" for n in range(13)]
        texts += list(copies(rng, base, 12, 3 + group))
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts)]
    assert run(spark, rows) == brute(rows, 2, 80)


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (None, "a b c d e f g"), (3, "A b C d e f g"), (4, None), (4, None), (7, "a b c d e f g"), (7, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.key_, r.n_shingles_, r.component_) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3, 3), (None, 3, None), (3, 3, 3), (4, 0, 4), (4, 0, 4), (7, 3, 3), (7, 3, 3)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(n, n + 1) for n in range(40)] + [(100, 150), (150, 120), (7, 7)] + [(200, n) for n in range(201, 260)]
    got = {r.rep_: r.comp_ for r in components(spark.createDataFrame(chain, "x_ long, y_ long")).collect()}
    assert got == {**{n: 0 for n in range(41)}, 100: 100, 150: 100, 120: 100, **{n: 200 for n in range(200, 260)}}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op6_near_duplicates"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and not all(r.kept for r in got)
