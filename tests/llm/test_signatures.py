import numpy as np
import pytest

from tableprobe.llm import signature_trees as module
from tableprobe.llm.queries import QUERIES
from tableprobe.llm.signature_trees import jaccard_components, segment_keys
from tests.llm.test_near_duplicates import brute, copies


def run(spark, rows, size=3, percent=90):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_ int").repartition(3)
    return sorted((r.key_, r.n_shingles_, r.component_) for r in jaccard_components(docs, size=size, percent=percent).collect())


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(3000):
        n = int(np.exp(rng.uniform(0, 7))) + 1
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep, add = rng.uniform(0, (100 - percent) / 100, 2)
        b = np.unique(np.concatenate([a[rng.random(len(a)) >= keep / 2], rng.integers(0, 2**63, int(add * n / 2) + rng.integers(0, 2)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(segment_keys(a, percent), segment_keys(b, percent)))


@pytest.mark.parametrize("leaf,levels", [(1024, 3), (5, 3), (3, 2)])
def test_groups_like_brute_force(spark, monkeypatch, leaf, levels):
    monkeypatch.setattr(module, "LEAF_SETS", leaf)
    monkeypatch.setattr(module, "LEVELS", levels)
    monkeypatch.setattr(module, "FAN", 3)
    monkeypatch.setattr(module, "GROUP", 2)
    monkeypatch.setattr(module, "PARTNERS", 20)
    rng = np.random.default_rng(leaf)
    pool = [f"w{n}" for n in range(4000)]
    texts = []
    for count, edits, length in [(2, 1, 60), (3, 2, 90), (40, 3, 80), (150, 6, 160), (60, 9, 220), (5, 1, 12), (50, 1, 14)]:
        texts += list(copies(rng, list(rng.choice(pool, length)), count, edits))
    texts += [" ".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(100)]
    texts += [texts[0], texts[0], "one", "ONE", "one ", "", "\n", "a b", "A  b", "a b c", "x " * 30_000, "x x"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts)]
    assert run(spark, rows) == brute(rows, 3, 90)


def test_far_first_set_and_chains(spark, monkeypatch):
    """The first set of a tree is linked with few others; the others hang together without it."""
    monkeypatch.setattr(module, "LEAF_SETS", 8)
    rng = np.random.default_rng(5)
    base = [f"w{n}" for n in range(200)]
    rows = []
    for key in range(60):
        text = list(base)
        for at in range(0, 3 * (key // 4), 12):
            text[at] = f"late{at}"
        text[int(rng.integers(0, 200))] = f"new{key}"
        rows.append((key, " ".join(text)))
    assert run(spark, rows) == brute(rows, 3, 90)


@pytest.mark.parametrize("few", [0, 1000])
def test_sets_of_wanted_rows(spark, monkeypatch, few):
    monkeypatch.setattr(module, "BROADCAST_IDS", few)
    numbers = [0, 1, 2, 7, 8, 9, 32767, 32768, 32769, 65536, (1 << 33) - 1, 1 << 33, (1 << 33) + 32768, (5 << 33) + 3]
    rows = spark.createDataFrame([(n, bytes([n % 251])) for n in numbers], "row_ long, set_ binary")
    wanted = spark.createDataFrame([(n, k) for k, n in enumerate(numbers[::2] + numbers[:3])], "row_ long, k_ int")
    got = module.with_sets(wanted, rows)
    assert sorted((r.row_, r.k_, r.set_) for r in got.collect()) == sorted((r.row_, r.k_, bytes([r.row_ % 251])) for r in wanted.collect())


def test_keys_are_shuffled_once(spark):
    """Runs of one key go over the ends of batches; the first row of a key is paired with all others."""
    rows = [(k, r) for k in range(-3, 3) for r in range(k % 4 * 400)] + [(9, 5)]
    keyed = spark.createDataFrame(rows, "key_ long, row_ long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pairs = module.first_of_key(keyed)
        assert sorted(tuple(r) for r in pairs.collect()) == sorted((0, r) for _, r in rows[:-1] if r)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_few_and_many_rows(spark, monkeypatch, ids):
    monkeypatch.setattr(module, "BROADCAST_IDS", ids)
    rng = np.random.default_rng(3)
    pool = [f"w{n}" for n in range(500)]
    texts = [t for length in (40, 70, 90) for t in copies(rng, list(rng.choice(pool, length)), 12, 4)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows, 3, 90)


def test_odd_rows(spark):
    text = " ".join(f"w{n}" for n in range(80))
    rows = [(5, text), (None, text), (3, text.upper()), (4, None), (4, None), (7, text + " end"), (7, text + " end"), (9, text), (9, "other words of the same id"), (11, "other words of the same id"), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.key_, r.n_shingles_, r.component_) for r in jaccard_components(docs).collect()), key=str)
    want = [(5, 78, 3), (None, 78, None), (3, 78, 3), (4, 0, 4), (4, 0, 4), (7, 79, 3), (7, 79, 3), (9, 78, 3), (9, 4, 3), (11, 4, 3), (12, 0, 12)]
    assert got == sorted(want, key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op13_ngram_jaccard_join"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90)
