from collections import Counter

import numpy as np
import pytest

from tableprobe.llm import quality_rules as module
from tableprobe.llm.quality_rules import apply_rules


def repeated_words(text):
    """Words under windows of three words that occur more than once."""
    w = (text or "").split()
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(windows)
    return len({k + n for k, window in enumerate(windows) if count[window] > 1 for n in range(3)})


@pytest.mark.parametrize("bits", [20, 3])  # with 3 bits, texts of 8 windows and more are sorted as structs
def test_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(module, "INDEX_BITS", bits)
    rng = np.random.default_rng(bits)
    texts = [None, "", " \n\t ", "one", "a b c", "a a a a", "a b c a b c", "same\nsame\n\nother ...", "- x\n* y\nz", "# $ the of", "long word " * 20_000]
    texts += [" ".join(rng.choice(list("abcd"), rng.integers(1, 40))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(4, "a b c"), (None, "a b c")]
    got = apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.key_), r.n_words, r.n_repeat_words) for r in got) == sorted(
        (str(key), len((text or "").split()), repeated_words(text)) for key, text in rows
    )
    by = {r.key_: r for r in got}
    assert all("words" in by[key].failed and not by[key].passed for key in (0, 1, 2, 3))
    assert (by[7].n_dup_lines, by[7].dup_line_ratio, by[7].ellipsis_line_ratio) == (1, 1 / 3, 1 / 3)
    assert (by[8].bullet_line_ratio, by[9].n_symbols, by[9].n_stop_words) == (2 / 3, 2, 2)
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
