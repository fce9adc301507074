import pytest
from pyspark.sql import functions as F
from tarn.llm.common import tokenizer_path
from tarn.llm import token_counts as module
from tarn.llm.token_counts import Counts, token_counts, token_counts_joined
from tokenizers import Tokenizer

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.mark.parametrize(
    "text", ["", " ", "a<|startoftext|>b c <|endoftext|>", "İstanbul Σας ΣΑΣ ſ", "x\x1cy \x85z w q", "é ́ 日本語 １２３ 🎉🎉", "<|endoftext|", "don't WE'LL 1234", "x" * 3000, " a　b"]
)
def test_odd_texts(library, text):
    assert int(Counts(PATH).of(text.encode().split()).sum()) == len(library.encode(text, add_special_tokens=False).ids)


def test_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in token_counts(df.withColumn("n_tokens", F.lit("x"))).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    rows = token_counts(spark.createDataFrame([(1, None), (1, "a")], "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == [(0, 0), (1, 1)]
    assert token_counts(df.limit(0)).count() == 0


def test_each_pre_token_is_counted_once(monkeypatch):
    """Runs that share a pre-token ask the model for it once; runs that come again ask nothing."""
    counts = Counts(PATH)
    asked = []
    of_piece = counts._of_piece
    monkeypatch.setattr(counts, "_of_piece", lambda piece: asked.append(piece) or of_piece(piece))
    first = counts.of([b"word,", b"word.", b"word,", b"word;"])
    assert first.tolist()[0] == first.tolist()[2] and asked.count("word") == 3 and len(counts.pieces) == 4
    assert counts.of([b"word,", b"word."]).tolist() == first.tolist()[:2] and len(asked) == 6


def test_frequencies_are_joined_to_counts(spark):
    """The corpus-wide join gives the same sums."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.createDataFrame([(-1, None, None, None, 0), (-2, " a a b ", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id: r.n_tokens for r in token_counts_joined(df).collect()}
    assert got == {r.doc_id: r.n_tokens for r in token_counts(df).collect() if r.n_tokens} and got[-2] == 3


def test_long_runs_are_not_kept_and_caches_are_bounded(monkeypatch):
    counts = Counts(PATH)
    counts.of([b"x" * 100_000])
    assert not counts.runs and not counts.pieces and counts.kept == 0
    monkeypatch.setattr(module, "CACHE_BYTES", 5_000)
    for k in range(300):
        counts.of([f"w{k}".encode()])
    assert len(counts.runs) < 100


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (1, "x" * 200_000)], "doc_id long, text string")
    rows = token_counts(df).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows[:3]] == [(1, 2), (1, 2), (None, 2)] and rows[3].over_limit
