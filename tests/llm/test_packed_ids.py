import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableprobe.llm.packed_ids import PieceEncoder, pack, read_blocks, read_documents, read_ids, unpack, write
from tableprobe.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 20, 32])
def test_pack_and_slices(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1000).astype(np.uint32)
    packed = pack(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    assert (unpack(packed, width, 0, 1000) == ids).all()
    assert (unpack(packed, width, 37, 500) == ids[37:537]).all()


def test_pieces_give_the_ids_of_the_text(tokenizer):
    texts = ["", " ", "  a b", "a\n\n  b ", "it's, don't.!?", "x\x1cy \x1c z", "é×÷, naïve... ", ".,! .,! x", "²½ 12ab,"]
    texts += ["漢字 かな, ok", "а́ б, в.", "<|endoftext|> hi", "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>\n\n<|endoftext|>  b c", "<|endoftext", "tab\t\tq ", "<http://a.b/c?d=e&f>, (x)."]
    rng = np.random.default_rng(3)
    letters = list("aZé×.,!' \n\t1²_-漢\x1c s😀ſ") + [" "] * 6
    texts += ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(3000)]
    encoder = PieceEncoder(PATH)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_special_tokens_are_tokens(tokenizer):
    assert PieceEncoder(PATH).encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_round_trip_random_access_and_odd_rows(spark, tokenizer, tmp_path):
    rows = [(5, "five five", "x"), (None, "no id", "x"), (2, None, "x"), (2, "two", None), (9, "long text. " * 30_000, ""), (7, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    write(docs, str(tmp_path), PATH, 2, block_tokens=50)
    got = {(r.key_, r.start): r for r in read_documents(spark, str(tmp_path), with_ids=True).collect()}
    start, stream = 0, []
    order = sorted(got, key=lambda k: k[1])
    assert [k[0] for k in order] == [None, 2, 2, 5, 7, 9]
    texts = {}
    for key, text, _ in rows:
        texts.setdefault(key, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    for key in order:
        row = got[key]
        assert row.start == start and row.ids in texts[row.key_]
        texts[row.key_].remove(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        start += row.n_tokens
        stream += row.ids
    assert not any(texts.values())
    assert read_ids(spark, str(tmp_path), 7, 40).tolist() == stream[7:47]
    assert {r.width for r in read_blocks(spark, str(tmp_path)).collect()} == {16}


def test_empty_table(spark, tmp_path):
    write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path), PATH, 2)
    assert read_documents(spark, str(tmp_path)).count() == 0


def test_query_against_whole_texts(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_packed_ids"](spark, folder).collect()}
    start = 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for doc in docs:
        ids = tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [2]
        assert got[doc.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)
