import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tarn.llm.bpe import _codec, decode, encode_by_join, encode_decode, fold_words, merge, read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def ids(text):
    return np.frombuffer(_codec(PATH, P.PATTERN).encode(text), dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert _codec(PATH, P.PATTERN).decode(np.array(ids(text), dtype="<u4").tobytes()) == text.encode()


def test_every_character():
    for start in range(0, 0x30000, 0x800):
        if 0xD800 <= start < 0xE000:
            continue
        for text in ("".join(f"a{chr(c)} {chr(c)}1" for c in range(start, start + 0x800)),):
            if ids(text) != LIBRARY.encode_ordinary(text):
                bad = [hex(c) for c in range(start, start + 0x800) if ids(f"a{chr(c)} {chr(c)}1") != LIBRARY.encode_ordinary(f"a{chr(c)} {chr(c)}1")]
                raise AssertionError(bad)


@pytest.mark.parametrize("text", ["", " ", "  a  \n\n b", "<|endoftext|>", "x" * 5000, "1" * 3000, "é" * 500, "don't WE'LL 'S", "\r\n\t x"])
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1000)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in encode_decode(df.withColumn("n_tokens", F.lit(1)).withColumn("__text", F.lit(1))).collect():
        want = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    two = encode_decode(spark.createDataFrame([(1, None), (2, "hello world")], "doc_id long, text string"), ids="array").orderBy("doc_id").collect()
    assert two[0].ids == [] and two[1].ids == LIBRARY.encode_ordinary("hello world")
    back = decode(encode_decode(df.limit(50), ids="array")).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    assert encode_decode(df.limit(0)).count() == 0


def test_fold(spark):
    words = ["", None, "a", " the", "thatre", " unbelievable", "éàü", "🎉x", "aaaaaaaa", "Ġ", " withanemoni"]
    rows = fold_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    ranks = read_ranks(PATH)
    for r in rows:
        assert r.ids == (None if r.word is None else merge(r.word.encode(), ranks)), r.word


def test_by_join(spark):
    """The fold over distinct words, joined back to texts, gives the same rows as the query's form."""
    rows = [(1, "The cat's hat, the cat  and\n\n 12 hats!"), (2, None), (3, ""), (4, "éàü 🎉x thatre"), (5, "the the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, encode_by_join(df).collect())) == sorted(map(tuple, encode_decode(df).collect()))


def test_repeated_rows_and_cache_bound(spark, monkeypatch):
    from tarn.llm import bpe

    df = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a b c")], "doc_id long, text string")
    assert len({tuple(r)[1:] for r in encode_decode(df).collect()}) == 1 and encode_decode(df).count() == 4
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5_000)
    codec = bpe.Codec(PATH, P.PATTERN)
    for k in range(500):
        codec.encode(f"word{k} other{k}")
    assert len(codec) < 100 and codec.encode("word1 other2") == np.array(LIBRARY.encode_ordinary("word1 other2"), dtype="<u4").tobytes()
