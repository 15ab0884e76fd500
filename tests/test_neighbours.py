"""The search inside a block: every pair that counts is found, few are measured."""

import numpy as np
import pytest

from tableprobe.operators import neighbours

METRICS = ["cosine", "euclidean", "manhattan"]


def brute(metric, ids, rows, k):
    out = {}
    for i, a in zip(ids, rows):
        with np.errstate(all="ignore"):
            if metric == "cosine":
                d = 1 - rows @ a / (np.linalg.norm(rows, axis=1) * np.linalg.norm(a))
            else:
                d = np.abs(rows - a).sum(axis=1) if metric == "manhattan" else np.sqrt(((rows - a) ** 2).sum(axis=1))
        near = sorted((round(float(x), 12), j) for j, x in zip(ids, d) if np.isfinite(x) and j != i)
        out[i] = near[:k]
    return out


def searched(metric, ids, rows, k):
    catalog = neighbours._Catalog(metric, k, ids, rows)
    at, near, d = catalog.search(ids, rows, True)
    out = {i: [] for i in ids}
    for a, n, x in zip(at, near, d):
        out[ids[a]].append((float(x), catalog.ids[n]))
    return out


def agree(got, want, rel):
    for i in want:
        assert [j for _, j in got[i]] == [j for _, j in want[i]], i
        assert [x for x, _ in got[i]] == pytest.approx([x for x, _ in want[i]], abs=2e-12, rel=rel)


@pytest.mark.parametrize("metric", METRICS)
def test_few_pairs_are_measured(monkeypatch, metric):
    rng = np.random.default_rng(4)
    n, measured, plain = 1500, [], neighbours._distances
    rows = rng.normal(size=(n, 24)).astype(np.float32).astype(float)
    ids = rng.permutation(n) * 7
    monkeypatch.setattr(neighbours, "_distances", lambda m, q, c: measured.append(len(q)) or plain(m, q, c))
    agree(searched(metric, ids, rows, 5), brute(metric, ids, rows, 5), 1e-12)
    assert sum(measured) < 0.15 * n * n


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("kind", ["copies", "grid", "scales", "wide", "huge", "far"])
def test_odd_vectors(metric, kind):
    rng = np.random.default_rng(6)
    n = 300
    rows = rng.normal(size=(n, 5))
    if kind == "copies":
        rows[rng.random(n) < 0.6] = rows[0]
    elif kind == "grid":
        rows = rng.integers(0, 3, (n, 5)).astype(float)
    elif kind == "scales":
        rows *= 10.0 ** rng.integers(-9, 6, (n, 1))
    elif kind == "wide":
        rows = rng.normal(size=(n, 300))
    elif kind == "huge":
        rows[:30] *= 1e30
    else:
        rows[:, 0] += 1e7
    rows[3], rows[4, 1], rows[5, 2] = 0.0, np.nan, np.inf
    ids = np.array([f"t{i:04d}" for i in rng.permutation(n)], dtype=object)
    agree(searched(metric, ids, rows, 4), brute(metric, ids, rows, 4), 1e-9)


def test_repeated_ids_and_queries_outside_the_catalog():
    rng = np.random.default_rng(8)
    rows, ids = rng.integers(0, 4, (400, 6)).astype(float), rng.integers(0, 120, 400)
    catalog = neighbours._Catalog("manhattan", 3, ids, rows)
    q = rng.integers(-30, 30, (80, 6)).astype(float)
    at, near, d = catalog.search(np.arange(80), q, True)
    for i in range(80):
        want = sorted((np.abs(rows - q[i]).sum(axis=1)[j], ids[j]) for j in range(400) if ids[j] != i)[:3]
        assert [(x, catalog.ids[n]) for a, n, x in zip(at, near, d) if a == i] == want
