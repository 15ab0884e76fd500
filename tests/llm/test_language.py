import zlib

import numpy as np

from tableprobe.llm.language import bits, fit, fit_sets, has_letter, identify, keep_identified, presence
from tableprobe.llm.queries import QUERIES


def test_presence_is_a_set_of_ngrams():
    assert (presence("abc abc") == presence("ABC, abc!")).all()
    assert presence("abc").sum() <= 4 + 4 + 3
    assert not presence(None).any() and not presence("").any()
    assert has_letter("1é") and not has_letter("12 %") and not has_letter(None)


def test_kernel_ridge_like_the_closed_form():
    texts = ["the and of to", "of the to and in", "der die das und", "und die der ein"]
    labels = np.array(["en", "en", "de", "de"], object)
    sets = bits(texts)
    model = fit_sets(sets, labels, landmarks=4, ridge=0.1)
    # With all rows as landmarks Nyström is exact: kernel ridge regression in its dual form.
    size = np.sqrt(sets.sum(1))
    kernel = (sets @ sets.T) / np.outer(size, size)
    targets = np.where(labels[:, None] == np.array(["de", "en"])[None, :], 1.0, -1.0)
    dual = kernel @ np.linalg.solve(kernel + 0.1 * np.eye(4), targets)
    assert np.allclose(model.kernel(sets) @ model.weights, dual, atol=1e-4)
    assert model.predict(["the of", "das ein", "", None, "12"])[0] == ["en", "de", "und", "und", "und"]


def test_held_out_accuracy_and_odd_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = QUERIES["op8_language_id"](spark, folder).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in lang if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_nulls_empty_and_unlabelled(spark):
    rows = [(1, "the and of " * 9, "en", 0), (2, "der die das " * 9, "de", 0), (None, None, None, 0), (4, "", "en", 0),
            (5, "123 456", None, 0), (6, "the of and", None, 0), (7, "und das die " * 20_000, None, 0), (6, "the of and", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score_ int")
    model = fit(docs)
    got = [(r.key_, r.lang_) for r in identify(docs, model).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "en"), (2, "de"), (None, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (7, "de")], key=str
    )
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 6, 7]
    assert [r.doc_id for r in keep_identified(docs, model, languages={"de"}).orderBy("doc_id").collect()] == [2, 7]
    nothing = fit(docs.where("lang is null"))
    assert {r.lang_ for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0
