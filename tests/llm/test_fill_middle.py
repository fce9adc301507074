import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tarn.llm.fill_middle import UNITS, Chunks, fill_in_middle, fim_digests, restored


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(key, text):
    """The contract's row by slicing the string."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, a, b - a, sha(out), sha(text)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = fim_digests(fill_in_middle(df.withColumn("form", F.lit(3)).withColumn("n", F.lit("x")))).collect()
    assert len(got) == len(texts) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r)[1:] == plain(r.doc_id, texts[r.doc_id])


ODD = [None, "", "a", "é", "a<P>b", "<S>", "<", "<P", "P><", "x<M", "M>y", "😀" * 3000, "\n\n", "é" * 5, "<S" * 2000, ">" * 9, "日本語。" * 4096, "b" * 4095, "b" * 4096, "b" * 4097]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4096])
def test_odd_texts_by_any_chunk(spark, chunk):
    texts = ODD if chunk == 4096 else [t and t[:60] for t in ODD]
    rows = [(k, t) for k in (None, *range(40)) for t in texts] + [(7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim_digests(fill_in_middle(df, chunk=chunk))
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in made.collect()), key=order) == sorted(((k, *plain(k, t)) for k, t in rows), key=order)
    assert fill_in_middle(df.limit(0)).count() == 0


def test_places_of_all_units():
    r = random.Random(4)
    for unit in UNITS:
        for chunk in (1, 2, 5, 64):
            texts = ["".join(r.choice("ab \n\té😀") for _ in range(r.randrange(0, 90))) for _ in range(30)]
            raws = [t.encode() for t in texts]
            got = Chunks(np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum([len(x) for x in raws]), unit, chunk)
            for d, t in enumerate(texts):
                before = "\n" + t[:-1]
                want = [i for i, (x, y) in enumerate(zip(before, t, strict=False)) if unit == "chars" or (unit == "lines" and x == "\n") or (unit == "words" and x in " \n\t" and y not in " \n\t")]
                assert got.units[d] == len(want)
                at = [len(t[:i].encode()) for i in want] + [len(raws[d])] * 2
                assert [got.place(d, k) for k in range(len(at))] == at


def test_only_the_owning_chunks_are_looked_through_again():
    """Two places in a text of 100 chunks read two chunks."""
    raw = b"word " * 2000
    units = Chunks(np.frombuffer(raw, dtype=np.uint8), np.array([len(raw)]), "words", 100)
    read = []
    plain_rule = units.begins_unit
    units.begins_unit = lambda before, byte: read.append(len(byte)) or plain_rule(before, byte)
    assert [units.place(0, 3), units.place(0, 1999), units.place(0, 2000)] == [15, 9995, 10000]
    assert read == [100, 100]


def test_words_and_lines_restore(spark):
    r = random.Random(9)
    rows = [(k, "".join(r.choice("ab  \n<PSM") for _ in range(r.randrange(0, 80)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for unit in ("words", "lines"):
        made = fill_in_middle(df, unit=unit).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        texts = dict(rows)
        assert all(x.back == texts[x.doc_id] for x in made)
        assert {x.form for x in made} == {"plain", "psm", "spm"}
        assert all(x.output == texts[x.doc_id] for x in made if x.form == "plain")
