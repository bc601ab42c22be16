"""Ids and bytes against the tiktoken library."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bpe

TEXTS = ["", None, "  a\n\n b\t\tc   d\x1c\x1dx  ", "it's 12,5٣ éé́ 😀😀 中文字 ﻿", "\n \n", "a" * 9000 + " " * 500, "x\r\n\r\n  y", "the cat " * 3000, "the cat " * 3000, "<|endoftext|> We'll I'D"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary()[0], special_tokens={})


def check(rows, texts, library):
    rows = sorted(rows, key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        ids = library.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chars", [1, 40, 10**6])
def test_odd_texts(spark, library, chars):
    df = spark.createDataFrame([(i or None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, block string")
    check(bpe.digests(df, chars=chars).collect(), TEXTS, library)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    check(bpe.op6_word_shuffle_bpe(spark, "/root/testdata/sf0.001").collect(), texts, library)


@pytest.mark.parametrize("text", ["the same text here", "", None])
def test_blocks_of_copies_stay_apart(spark, text, library):
    df = spark.createDataFrame([(None, text)] * 400, "doc_id long, text string").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        sizes = [r.n for r in bpe.encode(df, lambda keys, ids: [pa.array([len(keys)] * len(keys), pa.int64())], "n long").collect()]
        assert len(sizes) == 400 and max(sizes) <= 50
        check(bpe.digests(df.withColumn("doc_id", F.monotonically_increasing_id())).collect(), [text] * 400, library)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decode_joins_the_token_table(spark, library):
    ids = library.encode_ordinary("Hello wörld 😀")
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    rows = {r.doc_id: r.decoded for r in bpe.decode(df).collect()}
    assert bytes(rows[1]).decode() == "Hello wörld 😀" and bytes(rows[2]) == b"" and rows[3] is None
