"""The word lattice against all paths, and documents and queries analysed alike."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from tarn.operators import japanese, lattice
from tarn.operators import search as S
from tarn.operators.segments import SegmentedIndex

#: A few words made for the test; no dictionary.
WORDS = """東京,1,1,3000,名詞,固有,地域,*,*,*,東京,,
京都,1,1,2500,名詞,固有,地域,*,*,*,京都,,
東,2,2,4000,名詞,一般,*,*,*,*,東,,
都,3,3,2000,名詞,接尾,地域,*,*,*,都,,
に,4,4,500,助詞,格助詞,*,*,*,*,に,,
住ん,5,5,3000,動詞,自立,*,*,*,*,住む,,
住む,5,5,3000,動詞,自立,*,*,*,*,住む,,
で,4,4,500,助詞,接続助詞,*,*,*,*,で,,
いる,6,6,1000,動詞,非自立,*,*,*,*,いる,,
"""
MATRIX = "7 7\n1 3 -2000\n2 1 3000\n0 2 500\n5 4 -500\n4 6 -300\n"


@pytest.fixture(scope="module")
def dictionary(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("words")
    (folder / "w.csv").write_text(WORDS, encoding="utf-8")
    (folder / "m.def").write_text(MATRIX, encoding="utf-8")
    return lattice.read(spark, str(folder / "w.csv"), str(folder / "m.def"))


def test_connections_decide(dictionary):
    assert [t[0] for t in dictionary.tokens("東京都に住んでいる")] == ["東京", "都", "に", "住ん", "で", "いる"]
    assert dictionary.tokens("住ん")[0][:3] == ("住ん", "住む", "動詞")
    # without the connections the cheaper words win
    bare = lattice.Dictionary(dictionary.words)
    assert [t[0] for t in bare.tokens("東京都")] == ["東京", "都"] and bare.path("東京都")[0] == 5000


def test_unknown_words(dictionary):
    assert [t[0] for t in dictionary.tokens("Spark 4に タワー。")] == ["Spark", "4", "に", "タワー", "。"]
    assert dictionary.tokens("") == [] and dictionary.tokens(" \n") == []
    assert sum(len(t[0]) for t in dictionary.tokens("ア" * 100)) == 100


def every_path(d, text, i=0, right=0):
    """The cost of each way through a text."""
    if i == len(text):
        yield d.join(right, 0)
        return
    for end, w in d.at(text, i):
        for rest in every_path(d, text, end, w[1]):
            yield d.join(right, w[0]) + w[2] + rest


def test_least_cost_of_all_paths():
    r = random.Random(4)
    for _ in range(40):
        parts = ["".join(p) for n in (1, 2, 3) for p in itertools.product("あいう", repeat=n)]
        words = {w: [(r.randrange(4), r.randrange(4), r.randrange(1, 900), "名詞", "一般", "", w) for _ in range(r.randrange(1, 3))] for w in r.sample(parts, 14)}
        d = lattice.Dictionary(words, {(a, b): r.randrange(-300, 300) for a in range(4) for b in range(4)})
        text = "".join(r.choice("あいう") for _ in range(8))
        cost, path = d.path(text)
        assert cost == min(every_path(d, text)) and "".join(text[a:b] for a, b, _ in path) == text


def test_too_large(spark, tmp_path, monkeypatch):
    (tmp_path / "w.csv").write_text(WORDS, encoding="utf-8")
    monkeypatch.setattr(lattice, "MOST_ENTRIES", 3)
    with pytest.raises(ValueError):
        lattice.read(spark, str(tmp_path / "w.csv"))


def test_documents_and_queries_alike(spark, tmp_path, dictionary):
    """An index of analysed documents answers a query in another form of the word."""
    run = lattice.analyzer(spark, dictionary)
    rows = [(1, "東京都に住んでいる"), (2, "京都に住む"), (3, "東に"), (4, None)]
    df = spark.createDataFrame(rows, "doc long, text string")
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    index.add(df, "doc", {"content": F.col("text")}, lambda c: lattice.terms(run(c)))
    asked = [t[1] for t in dictionary.tokens("住ん")]
    hits = {r.doc for r in S.lexical(index.view(), asked, {"content": 1.0}).collect()}
    assert hits == {1, 2} and {r.doc for r in S.lexical(index.view(), ["京都"], {"content": 1.0}).collect()} == {2}
    k = df.select("doc", run(F.col("text")).alias("t")).select("doc", japanese.keywords(F.col("t"), 2).alias("k")).where("doc = 1").first().k
    assert k[0] == "東京"
