"""Token files: the library's ids, a round trip, and odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import token_output as T
from touchline.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \t\n ", "It's  THE we'll 'so !'s 12,5 a\x0bb", "ÀÉÎ ßtraße ×÷ ﬁ café café ΑΣ ὈΔΟΣ", "x <|endoftext|> y <|startoftext|>", "日本語 テキスト",
       " nbsp\x85next\x1cfs µªº İstanbul", "😀 emoji", "a" * 30_000, "don't can't I'd 'Re 'LL", "naïve line"]


def brute(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [T.END_ID]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_library_s(text):
    got = T.WordEncoder.of(PATH).serialised([text.encode()], "<u2")[0]
    assert np.frombuffer(got, "<u2").tolist() == brute(text)


def test_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (4, None), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "a long, b string, c int, d string").toDF("doc_id", "text", "TEXT", "Doc_Id")
    path = T.write_tokens(docs, fresh_path(spark, "tokens"), PATH)
    got = sorted(T.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    at = 0
    by_id = {i: t for i, t in rows}
    for r in got:
        ids = brute(by_id[r["doc_id"]])
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [x.tolist() for x in T.read_document(spark, path, 9)] == [brute(ODD[3])]
    assert len(T.read_document(spark, path, 5)) == 2 and not T.read_document(spark, path, 7)


def test_empty_table(spark):
    assert T.token_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_of_the_smallest_set(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in T.op8_token_output(spark, sf).collect():
        assert r["n_tokens"] == len(brute(texts[r["doc_id"]]))


def test_another_dictionary_is_refused():
    blob = T.encode_shard(np.array([1]), [1], [b"x"], b"\0" * 32, 2)
    with pytest.raises(ValueError):
        T.Shard(blob, b"")
