import zlib

import numpy as np
from pyspark.sql import functions as F
from tarn.llm.language import CELLS, grams, language_id, mixtures, train


def test_grams_count_every_letter():
    doc, cell, n, has = grams(["Ab c!", None, "", "12 .", "é" * 50])
    assert n[doc == 0].sum() == 3 and n[doc == 4].sum() == 50
    assert has.tolist() == [True, False, False, False, True]
    # a text's grams do not depend on its neighbours
    again = grams(["Ab c!"])
    assert (again[1] == cell[doc == 0]).all()


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id(df.withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == df.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, table = train(df)
    text = {r.lang: r.text for r in df.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    half = mixtures([text["fr"][:3000] + " " + text["de"][:3000], text["es"][:5000], None, "123", ""], names, table)
    assert half["lang_pred"][0] in ("fr", "de") and 0.3 < half["score"][0] < 0.7
    assert half["languages"][0].count(":") == 2 and half["languages"][1].startswith("es:1")
    assert half["lang_pred"][2:] == ["und"] * 3 and half["score"][2:].tolist() == [0, 0, 0]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id(df).collect()} == {"und"}
    assert language_id(df.limit(0)).count() == 0


def invented(n):
    """Languages over alphabets of their own, so that every share can be told."""
    return {f"l{i}": "".join(chr(0x3B1 + 6 * i + j) for j in range(6)) for i in range(n)}


def speech(letters, seed, words=400):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list(letters), size=5)) for _ in range(words))


def test_any_number_of_languages(spark):
    own = invented(6)
    rows = [(i, speech(a, i, 2000), name) for i, (name, a) in enumerate(own.items())]
    names, table = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [" ".join(speech(own[f"l{i}"], 90 + i) for i in range(k)) for k in range(1, 7)]
    got = mixtures(mixed, names, table)["languages"]
    assert [s.count(":") for s in got] == [1, 2, 3, 4, 5, 6]
    shares = dict(x.split(":") for x in got[4].split(","))
    assert set(shares) == {f"l{i}" for i in range(5)} and all(abs(float(v) - 0.2) < 0.05 for v in shares.values())


def test_ties_repeats_and_long_texts(spark):
    own = invented(2)
    rows = [(i, speech(a, i, 2000), name) for i, (name, a) in enumerate(own.items())]
    # two names for the same texts: equal likelihoods
    rows.append((9, rows[0][1], "a0"))
    names, table = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert mixtures([speech(own["l0"], 7)], names, table)["lang_pred"] == ["a0"]
    df = spark.createDataFrame([*rows, *rows, (None, rows[1][1] * 50, None), (4, None, None)], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in language_id(df).collect()]
    assert len(got) == 8 and got.count((1, "l1", zlib.crc32(b"1") % 5 == 0)) == 2
    assert (None, "l1", False) in got and (4, "und", zlib.crc32(b"4") % 5 == 0) in got


def test_against_a_grid_of_shares():
    """Of every pair of languages and every share by hundredths the penalised likelihood finds what EM finds."""
    r = np.random.default_rng(5)
    table = r.dirichlet(np.full(CELLS, 0.02), size=3) + 1e-9
    table /= table.sum(axis=1, keepdims=True)
    names = ["a", "b", "c"]
    texts = [" ".join("".join(r.choice(list("abcdefghij"), size=4)) for _ in range(n)) for n in (3, 20, 60, 200) for _ in range(6)]
    doc, cell, n, _ = grams(texts)
    got = mixtures(texts, names, table)
    for d in range(len(texts)):
        c, w = cell[doc == d], n[doc == d]
        value = lambda q: float((w * np.log(q @ table[:, c])).sum())  # noqa: B023, E731
        cost = 0.5 * np.log(max(w.sum(), 2))
        options = [value(np.eye(3)[i]) - cost for i in range(3)]
        grid = np.arange(1, 100) / 100
        pairs = [max(value(np.eye(3)[i] * s + np.eye(3)[j] * (1 - s)) for s in grid) - 3 * cost for i, j in ((0, 1), (0, 2), (1, 2))]
        best = max([*options, *pairs])
        shares = {x.split(":")[0]: float(x.split(":")[1]) for x in got["languages"][d].split(",")}
        mine = value(np.array([shares.get(k, 0) for k in names]) / sum(shares.values())) - cost * (2 * len(shares) - 1)
        # a set at least as good as any single language and any pair on the grid, to the grid's step
        assert mine >= best - 0.02 * max(1, w.sum() / 100), (d, mine, best)
