import hashlib
import math

import pytest

from tableprobe.llm.mixing import mix, plan


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute(rows, budget, target, limit, block_docs):
    """(name, epoch) of every row that is taken, by walking through the permutations."""
    words = [(name, source or "", len((text or "").split())) for name, source, text in rows]
    tokens, docs = {}, {}
    for _, source, n in words:
        tokens[source] = tokens.get(source, 0) + n
        docs[source] = docs.get(source, 0) + 1
    total = sum(tokens.values())
    budget = total if budget is None else budget
    p = {s: n / total for s, n in tokens.items() if n}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def repeat(a):
        return max(weights(a)[s] * budget / tokens[s] for s in p)

    a = 1_000_000
    if entropy(1.0) < target * math.log(len(p)):
        low, high = 0, a
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if entropy(mid / 1e6) < target * math.log(len(p)) else (mid, high)
        a = low
    if repeat(0.0) > limit:
        low, high = 0, 1_000_000
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if repeat(mid / 1e6) <= limit else (mid, high)
        a = max(a, high)
    out = []
    for s, w in weights(a / 1e6).items():
        goal = math.floor(round(w * budget, 3))
        epochs, rest = divmod(goal, tokens[s])
        mine = [(name, n, int(md5(f"block:{name}")[:8], 16) % -(-docs[s] // block_docs)) for name, source, n in words if source == s]
        out += [(name, e) for e in range(1, epochs + 1) for name, *_ in mine]
        e, used = epochs + 1, 0
        for name, n, _ in sorted(mine, key=lambda m: (md5(f"7:{e}:{s}/{m[2]}"), md5(f"7:{e}:{m[0]}"))):
            used += n
            if used > rest or rest == 0:
                break
            out.append((name, e))
    return sorted(out)


@pytest.mark.parametrize(("budget", "target", "limit", "block"), [(None, 0.95, 4.0, 4096), (None, 0.99, 1.5, 7), (5000, 0.9, 2.0, 3), (300, 0.95, 9.0, 5)])
def test_placements_like_brute_force(spark, budget, target, limit, block):
    rows = [(str(n), "abcd"[min(3, int(n**0.5) % 7)], "w " * (n % 13 + 1)) for n in range(250)]
    rows += [("900", None, "few words"), ("901", "e", ""), ("902", "e", None), ("903", "f", "long " * 500)]
    docs = spark.createDataFrame([(int(n), s, t, 1) for n, s, t in rows], "doc_id long, source string, text string, n_ int")
    sources, count = plan(docs, budget=budget, target_entropy=target, max_repeat=limit, block_docs=block)
    got = mix(docs, sources, count)
    assert got.columns[:4] == docs.columns
    assert sorted((str(r.doc_id), r.epoch_) for r in got.collect()) == brute(rows, budget, target, limit, block)


def test_odd_rows(spark):
    rows = [(None, "some text", "a"), (None, "other text", "a"), (1, "x y z", None), (2, "x y z", ""), (2, "x y z", ""), (3, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources, count = plan(docs, target_entropy=0.0)
    assert count == 3
    # At the natural shares every row with tokens is taken once.
    got = [(r.doc_id, r.text) for r in mix(docs, sources, count).collect()]
    assert sorted(got, key=str) == sorted([r[:2] for r in rows if r[1]], key=str)
    none = docs.limit(0)
    sources, count = plan(none)
    assert mix(none, sources, count).count() == 0
    blank = docs.where("text is null")
    sources, count = plan(blank)
    assert mix(blank, sources, count).count() == 0


def test_columns_with_the_names_of_the_mix_keep_their_values(spark):
    rows = [(n, "a" if n % 3 else "b", f"w{n} x y", "keep", "t", n, "s") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, name_ string, tokens_ string, blocks_ int, source_ string")
    sources, count = plan(docs, block_docs=8)
    mixed = mix(docs, sources, count)
    assert mixed.columns == [*docs.columns, "source__", "epoch_", "block_", "place_"]
    found = mixed.collect()
    assert found and {tuple(r)[:7] for r in found} <= {tuple(r) for r in rows}
    plain = docs.select("doc_id", "source", "text")
    same = mix(plain, *plan(plain, block_docs=8)).select("doc_id", "epoch_").collect()
    assert sorted((r.doc_id, r.epoch_) for r in found) == sorted(map(tuple, same))


def test_a_budget_beyond_the_repetition_limit_repeats_all_alike_and_warns(spark):
    docs = spark.createDataFrame([(1, "a", "one two three four five"), (2, "b", "six")], "doc_id long, source string, text string")
    with pytest.warns(UserWarning, match="more than 4"):
        found = mix(docs, *plan(docs, budget=60, max_repeat=4)).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, found)) == [(1, 10), (2, 10)]
