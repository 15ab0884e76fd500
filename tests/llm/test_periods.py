import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprobe.llm import periods as module
from tableprobe.llm.periods import WaveletMatrix, periodic_runs, repetitions, words
from tableprobe.llm.queries import QUERIES
from tableprobe.llm.query_periods import repeated


def brute(symbols, least=12):
    """(start, length, period) of all runs: every period is tried along the whole row."""
    n, found = len(symbols), {}
    for q in range(1, n // 2 + 1):
        same = [symbols[i] == symbols[i + q] for i in range(n - q)] + [False]
        start = None
        for i, ok in enumerate(same):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i + q - start >= max(least, 2 * q):
                    found.setdefault((start, i + q - start), q)
                start = None
    return sorted((s, size, q) for (s, size), q in found.items())


def collapsed(row, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return b" ".join(w for i, w in enumerate(row) if i not in gone)


def found(symbols, least=12):
    start, end, period = repetitions(np.array(symbols, np.int64), least)
    return sorted(zip(start.tolist(), (end - start).tolist(), period.tolist()))


@settings(max_examples=600, deadline=None)
@given(st.data())
def test_like_brute_force(data):
    part = st.lists(st.integers(0, data.draw(st.integers(0, 3))), min_size=1, max_size=9)
    row = []
    for _ in range(data.draw(st.integers(1, 6))):
        row += data.draw(part) * data.draw(st.integers(1, 9))
    assert found(row) == brute(row)


@pytest.mark.parametrize("row", [[0] * 300, [0, 1] * 150, ([0] * 20 + [1]) * 14, [0] * 60 + [1] + [0] * 60, list(range(40)) * 3 + [1, 2], [], [1] * 11])
def test_deep_periods(row):
    assert found(row) == brute(row)
    assert found(row, 4) == brute(row, 4)
    assert found(row, 30) == brute(row, 30)


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert found(b) == brute(b)
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    assert found(morse) == brute(morse)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    left = rng.integers(0, 500, 300)
    right = np.array([rng.integers(x, 501) for x in left])
    value = rng.integers(0, 700, 300)
    m = WaveletMatrix(values)
    assert m.below(left, right, value).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(left, right, value)]
    some = right > left
    left, right = left[some], right[some]
    rank = np.array([rng.integers(0, b - a) for a, b in zip(left, right)])
    assert m.smallest(left, right, rank).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(left, right, rank)]


@pytest.mark.parametrize("size", [1 << 16, 50])
def test_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(module, "BATCH_WORDS", size)
    rows = [(1, "a b " * 20), (1, "a b " * 20), (None, "x y z\n" * 9), (2, None), (3, ""), (4, " \n\t"), (5, "one"), (6, "very long " * 60_000), (7, "p q r " * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs_ int")
    got = periodic_runs(docs).collect()
    want = []
    for key, text in rows:
        row = words(text)
        runs = brute(row) if len(row) < 999 else [(0, 120_000, 2)]
        want.append((key, len(row), runs, collapsed(row, runs).decode()))
    assert sorted(((r.key_, r.n_, [tuple(x) for x in r.runs_], r.collapsed_) for r in got), key=str) == sorted(want, key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_like_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs) and any(r.n_runs > 1 for r in got.values())
    for doc in docs:
        row = repeated(doc.doc_id, words(doc.text))
        if len(row) > 2500:
            continue  # trying all periods takes the square of the length; other tests have long runs
        runs, r = brute(row), got[doc.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(row, runs)).hexdigest()
