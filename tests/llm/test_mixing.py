import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tarn.llm import mixing
from tarn.llm.mixing import BLOCK, mix_documents, mix_sizes, permuted, plan


def goals(sizes):
    """The rule as stated, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if t[s] > 2 * sizes[s]]
        if not above:
            return t | capped
        capped |= {s: 2.0 * sizes[s] for s in above}


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
        if n == 100:
            assert [r.p for r in got] != list(range(n))


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_sizes(df.withColumn("s", F.lit(1)).withColumn("size", F.lit("x")).withColumn("start", F.lit(1))).collect()
    docs = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(docs)
    by, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
        assert 0 <= r.taken <= 2 * r["size"]
        by[docs[r.doc_id].source] += r["size"]
        taken[docs[r.doc_id].source] += r.taken
    want = goals(by)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == by[s] and r.target == pytest.approx(want[s])
    for s in by:
        assert abs(taken[s] - want[s]) <= 2 * BLOCK, s
    again = {r.doc_id: r.taken for r in mix_sizes(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_odd_tables(spark):
    df = spark.createDataFrame(
        [(1, "a " * 500, "x"), (1, "a " * 500, "x"), (2, None, "x"), (3, "", None), (4, "b c", None), (5, "d", "é"), (6, None, "empty")],
        "doc_id long, text string, source string",
    )
    rows = sorted(tuple(r) for r in mix_sizes(df).collect())
    assert len(rows) == 7 and [r[1] for r in rows] == [500, 500, 0, 0, 2, 1, 0]
    want = goals({"x": 1000, None: 2, "é": 1, "empty": 0})
    assert [r[3] for r in rows] == pytest.approx([want[s] for s in ("x", "x", "x", None, None, "é", "empty")])
    assert all(r[4] <= 2 * r[1] for r in rows)
    assert mix_sizes(df.limit(0)).count() == 0


def test_mixed_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = {r.doc_id: r for r in mix_sizes(df).collect()}
    out = mix_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in out.collect():
        got = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        words[r.doc_id] += len(got)
        assert r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or len(got) < sizes[r.doc_id]["size"]
    assert {d: n for d, n in words.items() if n} == {d: r.taken for d, r in sizes.items() if r.taken}


def test_shards_and_passes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, _, picks = plan(df)
    assert picks.groupBy("s", "block").count().where("count > 2").count() == 0
    assert picks.groupBy("s", "block", "pass").count().where("count > 1").count() == 0


def test_null_and_repeated_keys(spark):
    texts = [" ".join(f"{k}:{j}" for j in range(n)) for k, n in enumerate([70, 70, 90, 90, 90, 40, 40, 33])]
    keys = [None, None, 1, 1, 1, 2, 2, None]
    rows = [(d, t, "ab"[k % 2], k) for k, (d, t) in enumerate(zip(keys, texts))]
    # rows alike in all columns, with and without a key
    rows += [(5, "x " * 50, "a", 0)] * 3 + [(None, "y " * 45, "b", 0)] * 2 + [(None, None, "a", 1), (5, " ", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, no long")
    out = mix_documents(df).collect()
    by = defaultdict(int)
    for d, t, s, _ in rows:
        by[s] += len((t or "").split())
    want, got, seen = goals(by), defaultdict(int), defaultdict(int)
    for r in out:
        for w in (r.text or "").split():
            got[r.source] += 1
            seen[r.doc_id, r.no, w] += 1
    assert all(abs(got[s] - want[s]) <= 2 * BLOCK for s in by)
    assert sum(got.values()) == sum(r.taken for r in mix_sizes(df).collect())
    own = {(d, k, w) for d, t, _, k in rows for w in (t or "").split()}
    assert set(seen) <= own and all(n <= 2 for (_, _, w), n in seen.items() if ":" in w)
    # every row of a source that is used twice over stays whole in one pass at least
    full = {s for s in by if want[s] == 2 * by[s]}
    assert all(seen[d, k, w] == 2 for d, t, s, k in rows if s in full for w in (t or "").split() if ":" in w)
    assert sum(not (r.text or "").strip() for r in out) == 2
    again = mix_documents(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_multinomial_counts_decide_the_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)
    monkeypatch.setattr(mixing, "SHARD_GROUP", 3)
    many = spark.createDataFrame([(0, 300, 600), (1, 50, 70), (2, 500, 331), (3, 1, 1)], "s int, blocks long, slots long")
    drawn = defaultdict(dict)
    for r in mixing.draws(many).collect():
        drawn[r.shard][r.s] = r.drawn
    # every shard is full, and its counts scatter round the targets as a multinomial's do
    assert sorted(drawn) == list(range(26)) and [sum(c.values()) for _, c in sorted(drawn.items())] == [40] * 25 + [2]
    for s, p in ((0, 0.5988), (1, 0.0699), (2, 0.3303)):
        counts = np.array([drawn[k].get(s, 0) for k in range(25)])
        assert abs(counts.mean() - 40 * p) < 4 * np.sqrt(40 * p * (1 - p) / 25)
        assert 0.3 < counts.var() / (40 * p * (1 - p)) < 2.5
    got = defaultdict(dict)
    for r in mixing.deal(many).collect():
        got[r.s][r.shard] = (r.begin, r.upto)
    for s, slots in ((0, 600), (1, 70), (2, 331), (3, 1)):
        runs = sorted(got[s].values())
        assert runs[0][0] == 0 and runs[-1][1] == slots and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
        total = sum(c.get(s, 0) for c in drawn.values())
        for k, (a, b) in got[s].items():
            assert not total or abs((b - a) - drawn[k][s] * slots / total) <= 1


def test_blocks_are_the_words_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = mix_sizes(df).collect()
    blocks = mixing.mixed_blocks(df).collect()
    assert sum(len(b.words) for b in blocks) == sum(r.taken for r in sizes)
    want, got, left = Counter(), Counter(), Counter()
    for d in df.collect():
        want.update((d.source, w) for w in re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    for b in blocks:
        got.update((b.source, w) for w in b.words)
    assert all(n <= 2 * want[k] for k, n in got.items())
    # all but a source's last block are whole
    for b in blocks:
        left[b.source] += len(b.words) < BLOCK
    assert all(n <= 2 for n in left.values())
    shards = Counter(b.shard for b in blocks)
    assert len(shards) > 3 and {r.first_shard for r in sizes if r.taken} <= set(shards)


def test_long_texts_and_ties(spark):
    long = "w " * 300_000
    df = spark.createDataFrame([(1, long, "a"), (1, "x " * 100, "a"), (1, "y " * 100, "a"), (2, None, None)], "doc_id long, text string, source string")
    rows = mix_sizes(df).collect()
    assert sorted(r["size"] for r in rows) == [0, 100, 100, 300_000] and all(r.taken <= 2 * r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * 300_200) <= 2 * BLOCK
