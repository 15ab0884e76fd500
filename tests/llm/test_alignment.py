import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprobe.llm import alignment as module
from tableprobe.llm.alignment import Alignment, Units, Vocabularies
from tableprobe.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("aZé×.,!' \n\t\r1²_-漢\x1c s😀ſ\xa0　▁\0 ") + [" "] * 8 + ["\n"] * 3 + ["the", "tion", "</s>", "<|endoftext|>", "<0x0A>"]


@pytest.fixture(scope="module")
def both():
    return Vocabularies(A, B)


def whole(both, text):
    """Ids of the whole text by A and B, or None if they do not spell it."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    spelled = (" " + text).encode()
    if b"".join(both.a_bytes[i] for i in a) != spelled or b"".join(both.b_bytes[i] for i in b) != spelled:
        return None
    return a, b


def brute(both, rows):
    """Contract columns, token by token."""
    out, held = [], defaultdict(set)
    for n, (key, text) in enumerate(rows):
        found = whole(both, text)
        if found is None:
            out.append([key, 0, 0, 0, Counter(), ""])
            continue
        spans = []
        for ids, names in ((found[0], both.a_bytes), (found[1], both.b_bytes)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(mine)
        pairs, j = Counter(), 0
        for s, e, a in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                pairs[a, spans[1][k][2]] += 1
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        i = j = 0
        for cut in cuts:
            mine = [[], []]
            while i < len(spans[0]) and spans[0][i][1] <= cut:
                mine[0].append(str(spans[0][i][2]))
                i += 1
            while j < len(spans[1]) and spans[1][j][1] <= cut:
                mine[1].append(str(spans[1][j][2]))
                j += 1
            groups.append(",".join(mine[0]) + "|" + ",".join(mine[1]))
        for p in pairs:
            held[p].add(n)
        out.append([key, len(found[0]), len(found[1]), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = {p: len(d) for p, d in held.items()}
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (key, a, b, g, sum(p.values()), sum(n for x, n in p.items() if count[x] == best[x[0]]), sum(n * count[x] for x, n in p.items()), sha)
        for key, a, b, g, p, sha in out
    ], count


def run(found):
    names = ["key_", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_"]
    return sorted((tuple(r[c] for c in names) for r in found.documents().collect()), key=str)


def units_of(both, text):
    units = Units(both)
    (numbers,) = units.numbers([text])
    if numbers is None or not units.good[numbers].all():
        return None
    pairs = [[[int(i) for i in side.split(",")] for side in g.split("|")] for k in numbers for g in units.texts[k].split(";")]
    return [i for a, _ in pairs for i in a], [i for _, b in pairs for i in b]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=14).map("".join))
def test_units_give_the_ids_of_the_text(both, text):
    assert units_of(both, text) == (whole(both, text) and tuple(map(list, whole(both, text))))


def test_identity_map(both):
    assert all(both.b_bytes[b] == both.a_bytes[a] for a, b in enumerate(both.same) if b >= 0)
    spelled = set(both.b_bytes)
    assert all((b >= 0) == (both.a_bytes[a] in spelled) for a, b in enumerate(both.same) if both.a_bytes[a])


@pytest.mark.parametrize("frequent", [65_536, 3])
def test_odd_rows_like_brute_force(spark, both, monkeypatch, frequent):
    monkeypatch.setattr(module, "FREQUENT", frequent)
    monkeypatch.setattr(module, "COUNTED_AT_ONCE", 50)
    monkeypatch.setattr(module, "UNITS", 60)
    rng = np.random.default_rng(frequent)
    rows = [(n, "".join(rng.choice(LETTERS, rng.integers(0, 60)))) for n in range(300)]
    rows += [(5, None), (None, "aaaa aaaa"), (None, None), (7, ""), (7, "same text"), (7, "same text"), (8, "▁ no"), (9, "aaa " * 40_000), (10, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_a string")
    found = Alignment(docs, A, B)
    want, count = brute(both, rows)
    assert run(found) == sorted(want, key=str)
    assert {(r.a, r.b): r.n for r in found.pairs().collect()} == count
    assert run(Alignment(docs.limit(0), A, B)) == []
    assert run(Alignment(docs.where("text is null"), A, B)) == sorted([(5, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_query_like_brute_force(spark, both):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op11_cross_tokenizer_alignment"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(brute(both, rows)[0])
