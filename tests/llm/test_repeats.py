import hashlib

import numpy as np
import pytest

from tableprobe.llm.queries import QUERIES
from tableprobe.llm.repeats import names_of_texts, remove_repeats, split


def brute(rows, window=13):
    """(id, words, removed, kept text) with all windows in one table."""
    least = {}
    words = [(key, split(text)) for key, text, *_ in rows]
    for key, w in words:
        if key is not None:
            for i in range(len(w) - window + 1):
                s = tuple(w[i : i + window])
                least[s] = min(key, least.get(s, key))
    out = []
    for key, w in words:
        gone = set()
        if key is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < key:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((key, len(w), len(gone), kept))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, name_ string")
    got = remove_repeats(docs)
    return sorted(((r.key_, r.n_words_, r.n_removed_, r.kept_) for r in got.collect()), key=str)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_equal_windows_have_equal_names_anywhere(rounds):
    rng = np.random.default_rng(rounds)
    for _ in range(300):
        core = rng.integers(1, rng.choice([2, 3, 5, 50, 1000]), 13).astype(np.uint64)
        texts = [
            np.concatenate([rng.integers(1, 4, rng.integers(0, 20)), core, rng.integers(1, 4, rng.integers(0, 20))]).astype(np.uint64)
            for _ in range(4)
        ]
        found = set()
        for text, names in zip(texts, names_of_texts(texts, 13, rounds)):
            found |= {int(names[i]) for i in range(len(text) - 12) if (text[i : i + 13] == core).all()}
        assert len(found) == 1


def test_random_texts_like_brute_force(spark):
    rng = np.random.default_rng(1)
    pool = [f"w{n}" for n in range(60)]
    passages = [list(rng.choice(pool, rng.integers(10, 40))) for _ in range(6)] + [["run"] * 30, ["a", "b"] * 20]
    rows = []
    for key in range(120):
        text = list(rng.choice(pool, rng.integers(0, 30)))
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, len(p))
            text += p[a : a + rng.integers(1, 40)] + list(rng.choice(pool, rng.integers(0, 10)))
        rows.append((int(key), rng.choice([" ", "\n", " \t"]).join(text)))
    long = " ".join(passages[0] * 2_000)
    rows += [(None, rows[3][1]), (None, None), (200, None), (201, ""), (202, long), (203, long), (5, rows[5][1]), (7, rows[9][1] + ' and more of it'), (205, rows[9][1]), (205, rows[11][1] + ' tail'), (204, "é " * 13 + "Ü")]
    assert run(spark, rows) == brute(rows)


def test_hot_passage_and_empty_table(spark):
    passage = " ".join(f"p{n}" for n in range(20))
    rows = [(n, f"own{n} {passage} end{n}") for n in range(500)]
    got = run(spark, rows)
    assert sorted(r[2] for r in got) == [0] + [20] * 499
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute(docs)]
    got = sorted((tuple(r) for r in QUERIES["op7_substring_dedup"](spark, folder).collect()), key=str)
    assert got == sorted(want, key=str)
    assert any(g for _, _, g, _ in want)
