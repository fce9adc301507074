import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tarn.llm.quality import measure, quality, quality_filter, suffix_repeats


def plain(text):
    text = text or ""
    words = text.encode().split()
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def verdict(text):
    """Whether a text stays, by comparing its five-word windows and nothing else."""
    words = [w.decode() for w in (text or "").encode().split()]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    if len(words) < 10 or 100 * len(covered) > 20 * len(words):
        return False
    if sum(len(words[i]) for i in covered) > 0.15 * sum(map(len, words)):
        return False
    # a repeat of over 50 words: a window of 51 that occurs twice
    long = Counter(tuple(words[i : i + 51]) for i in range(len(words) - 50))
    return max(long.values(), default=0) < 2


def test_longest_repeats():
    r = random.Random(2)
    for n in (0, 1, 2, 5, 60, 200):
        for kinds in (1, 2, 5):
            ids = [r.randrange(kinds) for _ in range(n)]
            want = []
            for i in range(n):
                best = 0
                for j in range(n):
                    k = 0
                    while j != i and max(i, j) + k < n and ids[i + k] == ids[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
            assert suffix_repeats(np.array(ids, dtype=np.int64)).tolist() == want


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in quality(df.withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x"))).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == verdict(texts[r.doc_id])


def test_verdict_differs_from_the_base_rules():
    """Without the suffix array's part of the verdict these rows would stay."""
    r = random.Random(5)
    word = lambda n=8: "".join(r.choice("abcdefghij") for _ in range(n))
    share = " ".join(["é" * 30 + word() for _ in range(6)])  # few words, many code points
    few = f"{share} {' '.join(word() for _ in range(60))} {share}"
    long = " ".join(word() for _ in range(51))
    rest = " ".join(word() for _ in range(600))
    texts = [few, f"{long} {rest} {long}", f"{long[: long.rindex(' ')]} {rest} {long}", rest]
    got = measure(texts)
    assert not any(got["base_failed"]) and got["kept"].tolist() == [False, False, True, True] == list(map(verdict, texts))
    assert got["longest_repeat"].tolist() == [6, 51, 50, 0]


def test_verdict_changes_rows_of_documents(spark):
    rows = quality(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not kept and not base_failed").collect()
    assert 0 < len(rows) < 100 and all(x.covered_chars > 0.15 or x.longest_repeat > 50 for x in rows)


def test_repeated_rows_stay_rows(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text)] * 3 + [(None, text), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in quality(df).collect()) == [(0, True), (1, False), (1, True), (1, True), (1, True)]


def test_odd_texts(spark):
    texts = [None, "", " \n\t ", "a " * 30_000, " x y", "a\x1cb", "\n\na\n\na b\n"]
    got = measure(texts)
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(t)
    assert not got["kept"][0] and got["longest_repeat"][3] == 29_999
    # a long repeat alone is enough to reject
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    passage = " ".join(word() for _ in range(450))
    text = passage + " " + " ".join(word() for _ in range(9000)) + " " + passage
    assert not measure([text])["base_failed"][0] and not measure([text])["kept"][0]
    df = spark.createDataFrame([(1, None), (2, " ".join(word() for _ in range(40)))], "doc_id long, text string")
    assert [r.doc_id for r in quality_filter(df).collect()] == [2]
    assert quality(df.limit(0)).count() == 0
