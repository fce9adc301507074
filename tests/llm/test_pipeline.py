import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tarn.llm.mixing import BLOCK, mix_sizes
from tarn.llm.pii import redacted

from .test_bpe import LIBRARY
from .test_mixing import goals
from .test_ngram_join import brute as near
from .test_pii import every as personal
from .test_quality import verdict

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = out.collect()
        if k == 0:
            assert sorted(after) == sorted(r for r in before if verdict(r.text))
        elif k == 1:
            keep = {d for d, _, c in near([(r.doc_id, r.text) for r in before]) if d == c}
            assert sorted(after) == sorted(r for r in before if r.doc_id in keep)
        elif k == 2:
            texts = {r.doc_id: r.text for r in after}
            assert len(after) == len(before)
            assert all(texts[r.doc_id] == redacted(r.text, personal(r.text)) for r in before)
            assert all(r.n_chars == len(r.text) for r in after)
        elif k == 3:
            taken = {r.doc_id: r.taken for r in mix_sizes(docs).collect()}
            got = defaultdict(int)
            for r in after:
                got[r.doc_id] += len(r.text.encode().split())
            assert {d: n for d, n in taken.items() if n} == dict(got)
        else:
            want = Counter(hashlib.sha256(np.array(LIBRARY.encode_ordinary(r.text), dtype="<u4").tobytes()).hexdigest() for r in before)
            assert Counter(r.ids_sha256 for r in after) == want and all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in after)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out


def plainly(rows):
    """(doc_id, source, text) of the rows that the first three stages keep, as they leave them, without Spark."""
    rows = [r for r in rows if verdict(r.text)]
    keep = {d for d, _, c in near([(r.doc_id, r.text) for r in rows]) if d == c}
    return {r.doc_id: (r.source, redacted(r.text, personal(r.text))) for r in rows if r.doc_id in keep}


def test_run_against_brute_force(spark):
    """What run() gives: for each kept document the words of its cleaned text, in order, so often as the targets ask."""
    kept = plainly(spark.read.parquet(f"{SF}/documents.parquet").collect())
    words = {d: t.encode().split() for d, (_, t) in kept.items()}
    sizes = defaultdict(int)
    for d, (s, _) in kept.items():
        sizes[s] += len(words[d])
    want, got, passes = goals(sizes), defaultdict(int), Counter()
    out = corpus_pipeline.run(spark, SF).collect()
    for r in out:
        assert len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256
        text = LIBRARY.decode(np.frombuffer(r.ids, dtype="<u4").tolist())
        assert hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
        mine = text.encode().split()
        # in the text's own order, and the very text where nothing is left out
        it = iter(words[r.doc_id])
        assert all(w in it for w in mine) and (len(mine) < len(words[r.doc_id]) or text == kept[r.doc_id][1])
        got[kept[r.doc_id][0]] += len(mine)
        passes[r.doc_id] += 1
    assert all(abs(got[s] - want[s]) <= 2 * BLOCK for s in sizes) and max(passes.values()) <= 2
    again = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in again) == Counter((r.doc_id, r.ids_sha256) for r in out)


def test_repeated_rows_and_ties_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = " ".join(f"word{i} of the text" for i in range(30))
    rows = [(5, text, "en", "a", 0), (5, text, "en", "a", 0), (5, " ".join(f"other{i} words" for i in range(40)), "en", "a", 0), (None, text + " end", "en", "b", 0), (9, text, "en", "b", 0)]
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {5, None} and 9 not in {r.doc_id for r in out}
    assert sum(r.n_tokens for r in out) > 0


def test_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0)], docs.schema)
    folder = tmp_path / "t"
    some = docs.limit(5)
    some.union(rows).withColumn("kept", F.lit(1)).withColumn("node", F.lit("x")).write.parquet(str(folder / "documents.parquet"))
    some = spark.read.parquet(str(folder / "documents.parquet")).where("doc_id >= 0").select(docs.columns).collect()
    out = corpus_pipeline.run(spark, str(folder)).collect()
    # the mix may leave out or repeat documents, but takes none beside the kept ones; a single source is taken whole
    kept = plainly(some)
    assert {r.doc_id for r in out} <= set(kept) and len(kept) >= 1 and sum(r.n_tokens for r in out) > 0
    words = {d: len(t.encode().split()) for d, (_, t) in kept.items()}
    taken = sum(len(LIBRARY.decode(np.frombuffer(r.ids, dtype="<u4").tolist()).encode().split()) for r in out)
    want = sum(goals({s: sum(words[d] for d, (x, _) in kept.items() if x == s) for s in {x for x, _ in kept.values()}}).values())
    assert abs(taken - want) <= 2 * BLOCK * len(kept)
    docs.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_null_texts_through_each_stage(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, "s", 3), (2, "c " * 30, "en", "s", None)], docs.schema)
    got = Counter((r.doc_id, r.text) if k < 4 else (r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[k][1](spark, rows, SF).collect())
    every = Counter([(1, None), (None, "a b"), (2, "c " * 30)])
    if k == 0:
        assert got == Counter()  # two texts without ten words, one that repeats itself
    elif k in (1, 2):
        assert got == every
    elif k == 3:
        # the source's words up to twice; a row without words takes no part and stays
        assert {d for d, _ in got} == {1, None, 2} and got[1, None] == 1 and max(got.values()) <= 2
    else:
        assert got == Counter((d, len(LIBRARY.encode_ordinary(t or ""))) for d, t in every)
