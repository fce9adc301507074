import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tarn.llm.common import tokenizer_path
from tarn.llm.pieces import MODEL, CharMap, Decoder, PieceModel, decode_pieces, encode_pieces, message, piece_digests


@pytest.fixture(scope="module")
def raw():
    with open(tokenizer_path(MODEL), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    return sentencepiece.SentencePieceProcessor(model_proto=raw)


@pytest.fixture(scope="module")
def model(raw):
    return PieceModel(raw)


def told(library, text):
    """[(id, begin, end)] by the library, in bytes."""
    out = []
    for field, value in message(library.encode(text, out_type="serialized_proto")):
        if field == 2:
            p = dict(message(value))
            out.append((p[2], p.get(4, 0), p.get(5, 0)))
    return out


def mine(model, texts):
    ids, begins, ends, offsets = model.spans(texts)
    rows = list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))
    return [rows[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def texts_of(r, n):
    parts = ["the ", "tokens", " ", "  ", "   ", "▁", "\n", "\t", "é", "日本", "語。", "😀", "à", "\x00", "</s>", "<unk>", "<0x0A>", "1234", "ſ", "ing", "Un", "　", "‍", "،ال"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 25))) for _ in range(n)]


ODD = ["", " ", "   ", "a", " a ", "▁", "▁ ▁  ▁▁", "\n", "a" * 5000, " " * 999, "日" * 700, "ab" * 300 + " x", "\x00", "𓂀", "é" * 40]


def test_ids_and_spans_equal_the_library(library, model):
    texts = ODD + texts_of(random.Random(2), 600)
    assert mine(model, texts) == [told(library, t) for t in texts]
    assert mine(model, texts[::-1])[::-1] == mine(model, texts)


def test_decoding_equals_the_library(library, model):
    r = random.Random(3)
    bytes_first = [0, 1, 2, 3, 4, 130, 140, 230, 231, 243, 29871, 259]
    lists = [[r.choice(bytes_first) if r.random() < 0.6 else r.randrange(32000) for _ in range(r.randrange(0, 12))] for _ in range(800)]
    got = Decoder(model).decode(np.array([i for x in lists for i in x], dtype=np.int32), np.cumsum([0, *map(len, lists)]))
    assert [g.decode() for g in got] == [library.decode(x) for x in lists]


def test_surfaces_put_together_are_the_text(model):
    texts = texts_of(random.Random(4), 200)
    for t, row in zip(texts, mine(model, texts), strict=True):
        assert b"".join(t.encode()[a:b] for _, a, b in row) == t.encode()


def field(number, value):
    """A field in wire format."""

    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def compiled(entries):
    """A compiled map of the entries: each node in 256 places of its own, at the front of an array."""
    keys = {k.encode(): v.encode() for k, v in entries.items()}
    nodes = [b"", *sorted({k[:i] for k in keys for i in range(1, len(k) + 1)}, key=lambda k: (len(k), k))]
    base = {k: 256 * (i + 1) for i, k in enumerate(nodes)}
    place = {b"": 0} | {k: base[k[:-1]] ^ k[-1] for k in nodes[1:]}
    units, blob = [0] * (256 * (len(nodes) + 1)), b""
    # every other cell has a label no byte of its own place has, so that nothing else matches
    for i in range(len(units)):
        units[i] = (i & 0xFF) ^ 0xFF
    for k in nodes:
        jump = place[k] ^ base[k]
        word = jump << 10 if jump < 1 << 21 else jump >> 8 << 10 | 1 << 9
        units[place[k]] = word | (k[-1] if k else 0) | (256 if k in keys else 0)
        if k in keys:
            units[base[k]] = 1 << 31 | len(blob)
            blob += keys[k] + b"\0"
    packed = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(packed)) + packed + blob


ENTRIES = {"A": "a", "B": "b", "À": "à", "AB": "ab!", "ABC": "X Y", "　": " ", "\t": " ", "ſ": "s", "\x01": "", "½": "1/2", "…": "...", "ﬁ": "fi", "é": "é"}


def changed(raw, **flags):
    """The model with another normalizer: the map of ENTRIES, and flags."""
    out = b""
    for number, value in message(raw):
        if number == 3:
            value = field(1, b"own") + field(2, compiled(ENTRIES)) + b"".join(field(k, v) for k, v in ((3, flags.get("dummy", 1)), (4, flags.get("squeeze", 0)), (5, 1)))
        out += field(number, value)
    return out


def test_compiled_map():
    m = CharMap(compiled(ENTRIES))
    assert dict(m.entries()) == ENTRIES
    assert m.longest("xABCd".encode(), 1) == (3, b"X Y") and m.longest(b"ABd", 0) == (2, b"ab!") and m.longest(b"d", 0) is None
    assert CharMap(bytes(4)).longest(b"a", 0) is None and not list(CharMap(bytes(4)).entries())


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("dummy", [0, 1])
def test_longest_prefix_normalisation_equals_the_library(raw, squeeze, dummy):
    """With a map of many-to-many strings and both blank rules: ids and projected spans are the library's."""
    proto = changed(raw, squeeze=squeeze, dummy=dummy)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), PieceModel(proto)
    r = random.Random(6)
    parts = [*ENTRIES, *ENTRIES, " ", "  ", "the", "ing", "日", "▁", "c", "\n", "😀"]
    texts = [*ODD, *("".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(500))]
    for t, got in zip(texts, mine(model, texts), strict=True):
        assert got == told(library, t), t
    got = Decoder(model).decode(*(np.concatenate([x]) for x in (np.array([i for t in texts for i in library.encode(t)], dtype=np.int32), np.cumsum([0, *(len(library.encode(t)) for t in texts)]))))
    assert [g.decode() for g in got] == [library.decode(library.encode(t)) for t in texts]


def test_cache_is_bounded(library, model, monkeypatch):
    import tarn.llm.pieces as pieces

    monkeypatch.setattr(pieces, "CACHE_BYTES", 4000)
    small = PieceModel(open(tokenizer_path(MODEL), "rb").read())
    for t in texts_of(random.Random(7), 300):
        assert mine(small, [t]) == mine(model, [t])
        assert small.kept < 4000 + 30 * 300


def test_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = piece_digests(df.withColumn("ids", F.lit(3)).withColumn("n_tokens", F.lit("x"))).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_rows(spark, library):
    rows = [(None, None), (1, None), (2, ""), (3, "twice ▁ "), (3, "twice ▁ "), (None, "a\x00b"), (4, "word " * 20_000), (5, "日本語" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("ends", F.lit(1))
    made = encode_pieces(df)
    want = sorted((str(k), [x for x, _, _ in told(library, t or "")], [x for *_, x in told(library, t or "")]) for k, t in rows)
    assert sorted((str(r.doc_id), r.ids, r.ends) for r in made.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in decode_pieces(made).collect()) == sorted((str(k), (t or "").replace("▁", " ")) for k, t in rows)
    assert [r.text for r in decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]
    assert piece_digests(df.limit(0)).count() == encode_pieces(df.limit(0)).count() == 0
