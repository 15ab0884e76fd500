import numpy as np
import pytest

from tableprobe.llm import line_dedup as module
from tableprobe.llm.line_dedup import allowed, bag, bag_distance, drop_lines, repeated_lines, stripped, within
from tableprobe.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    """(id, lines, removed) from all pairs of lines of similar length."""
    first = {}
    for key, text in rows:
        if key is not None:
            for n, line in stripped(text):
                first[line] = min((key, n), first.get(line, (key, n)))
    lines = sorted(first, key=len)
    early = dict(first)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > 2 or not allowed(len(a)):
                break
            if within(a, b, allowed(len(a))):
                early[a], early[b] = min(early[a], first[b]), min(early[b], first[a])
    out = []
    for key, text in rows:
        mine = stripped(text)
        out.append((key, len(mine), [] if key is None else [n for n, line in mine if (key, n) > early[line]]))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h_ int")
    return sorted(((r.key_, r.lines_, r.removed_) for r in repeated_lines(docs).collect()), key=str)


def edited(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        at, what = rng.integers(0, max(1, len(line))), rng.integers(3) if line else 1
        if what == 0:
            line[at] = rng.choice(list("abcé"))
        elif what == 1:
            line.insert(at, rng.choice(list("abcé")))
        else:
            del line[at]
    return "".join(line)


def test_within_and_bag_like_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        a = "".join(rng.choice(list("abcé"), rng.integers(0, 45)))
        b = edited(rng, a, rng.integers(0, 5)) if a else "ab"
        d = distance(a, b)
        assert [within(a, b, k) for k in range(4)] == [d <= k for k in range(4)]
        assert bag_distance(np.array([bag(a)]).view(np.uint64), np.array([bag(b)]).view(np.uint64))[0] <= 2 * d


@pytest.mark.parametrize("limit", [1024, 6])
def test_random_lines_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "NODE_LIMIT", limit)
    rng = np.random.default_rng(limit)
    pool = ["".join(rng.choice(list("abcdefgh é"), n)) for n in (10, 19, 20, 25, 39, 40, 41, 60, 90, 150)] + ["x" * 45]
    rows = []
    for key in rng.permutation(200):
        lines = []
        for _ in range(rng.integers(0, 5)):
            lines.append(edited(rng, pool[rng.integers(len(pool))], rng.integers(0, 4)))
        rows.append((int(key), rng.choice(["\n", " \n\t"]).join(lines)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, "\n \n"), (503, "long " * 30_000), (504, "long " * 30_000 + "x")]
    assert run(spark, rows) == brute(rows)


def test_hot_line_texts_and_empty_table(spark):
    rows = [(n, f"own line number {n * 7919} of this\nthe same line in every document here") for n in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, removed_ int")
    found = repeated_lines(docs)
    assert sum(len(r.removed_) for r in found.collect()) >= 299
    texts = {r.doc_id: r.text for r in drop_lines(docs, found).collect()}
    assert texts[0] == rows[0][1] and "every document" not in texts[7] and len(texts) == 300
    assert drop_lines(docs, found).columns == docs.columns
    assert repeated_lines(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_lines, [int(n) for n in r.removed_lines.split(",") if n]) for r in QUERIES["op9_line_dedup"](spark, folder).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert all(r[1] >= len(r[2]) for r in got) and any(r[2] for r in got)
