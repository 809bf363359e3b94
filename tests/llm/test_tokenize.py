import random

import pytest

from strandline.llm.tokenize import VOCABULARIES, decode, encoder, token_counts, token_ids

PARTS = ["a", "b", "the ", "'", "s", "ll", " ", "  ", "\n", "\r\n", "\t", "1", "23", "é", "ß", "日本", "。", "!", "_", "\xa0", " ", "\x1c", "😀", "'re ", "don't", "x" * 30, " " * 20, "<|endoftext|>"]


def _docs():
    rnd = random.Random(3)
    docs = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 300)))) for i in range(150)]
    return docs + [(1000, None), (1001, ""), (1002, " " * 500), (1003, "a" * 500), (1004, "\n" * 300 + "x"), (1005, "a")]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 8), (200, 50), (100_000, 10)])
def test_ids_equal_direct_encoding_at_any_chunk_size(spark, chunk, overlap):
    docs = _docs()
    direct = encoder(VOCABULARIES, "byte_bpe_50k").bpe.encode_ordinary
    expected = {i: direct(t) if t else [] for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r[0]: r[1] for r in token_ids(df, chunk=chunk, overlap=overlap).collect()} == expected
    assert {r[0]: r[1] for r in token_counts(df, chunk=chunk, overlap=overlap).collect()} == {i: len(x) for i, x in expected.items()}


def test_round_trip_of_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in token_ids(docs).collect()}
    assert ids.keys() == texts.keys()
    assert all(decode(ids[i]) == texts[i] for i in texts)


def test_very_long_piece():
    enc = encoder(VOCABULARIES, "byte_bpe_50k")
    assert len(enc.encode(" " * 3_000_000)) > 0


def test_other_libraries_agree():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    enc = encoder(VOCABULARIES, "byte_bpe_50k")
    import numpy as np

    for _, t in _docs():
        if t:
            assert other.encode(t, add_special_tokens=False).ids == np.frombuffer(enc.encode(t), np.int32).tolist()


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids int")
    assert token_ids(df).collect() == []
    df = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, piece int")
    assert len(token_ids(df).collect()) == 1
