import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tableprobe.llm.decontamination import tiles, tokens
from tableprobe.llm.language import fit, has_letter
from tableprobe.llm.near_duplicates import keep_one
from tableprobe.llm.words import WordHashes
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_duplicates import brute as brute_near

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = at[name] = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            model = fit(spark.createDataFrame(before, docs.schema))
            want = [r for r in before if model.predict([r.text])[0][0] != "und"]
            assert want == [r for r in before if has_letter(r.text)]
        elif name == "near_duplicates":
            kept = {k for k, _, c in brute_near([(r.doc_id, r.text) for r in before], 5, 80) if k == c}
            want = [r for r in before if r.doc_id in kept]
            assert len(want) < len(before)
        elif name == "decontamination":
            words = WordHashes()
            items = [words.of(tokens(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

            def leaks(r):
                doc = words.of(tokens(r.text))
                return any(sum(n for *_, n in tiles(doc, item, 3)) >= 0.7 * len(item) for item in items)

            want = [r for r in before if not leaks(r)]
            assert len(want) < len(before)
        elif name == "source_mixing":
            taken = brute_mix([(str(r.doc_id), r.source, r.text) for r in before], None, 0.95, 4.0, 4096)
            by_id = {str(r.doc_id): r for r in before}
            want = [by_id[k] for k, _ in taken]
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            start, want = 0, []
            for r in sorted(before, key=lambda r: r.doc_id):
                ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
                want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
        assert rows(docs) == sorted((tuple(r) for r in want), key=str), name
        assert name == "packed_ids" or docs.columns == columns
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(at["packed_ids"])


def test_keep_one_of_odd_rows(spark):
    text = "one two three four five six seven eight"
    data = [(3, text, "x"), (1, text.upper(), "x"), (1, text.upper(), "y"), (None, text, "x"), (None, None, None), (4, "", "x"), (4, "", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, gone_ string")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, -1, 1, 4, 4]
    assert keep_one(docs.limit(0)).count() == 0
