import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tarn.llm import ngram_join
from tarn.llm.ngram_join import ngram_components, without_near_duplicates


def brute(rows):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in by.get(x, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                head[max(root(i), root(j), key=lambda k: rows[k][0])] = min(root(i), root(j), key=lambda k: rows[k][0])
        for x in s:
            by.setdefault(x, []).append(i)
    return sorted((rows[i][0], len(sets[i]), rows[root(i)][0]) for i in range(len(rows)))


def made(seed, n_groups=25):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("aeiou") + r.choice("klmnop")
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n_groups):
        base = [word() for _ in range(r.randint(3, 150))]
        if r.random() < 0.5:
            at = r.randint(0, len(base))
            base = base[:at] + passage + base[at:]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    # a chain in which neighbours link but ends do not
    chain = [word() for _ in range(100)]
    for k in range(30):
        texts.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    texts += ["", None, "  \n", "one two", "One TWO", "one two three", "Éa b c d e", "éa b c d e"]
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
        monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 1)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(7)).withColumn("n", F.lit("x"))
    got = sorted(tuple(r) for r in ngram_components(df).collect())
    assert got == brute(rows)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in ngram_components(df).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "a B c d e f"), (5, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_components(df).collect()) == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (5, 0, 5)]
    assert ngram_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_null_and_repeated_keys(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", most)
    words = [f"w{i}" for i in range(130)]
    near, middle, far = (" ".join(words[k : k + 100]) for k in (0, 12, 24))
    clean = " ".join(f"c{i}" for i in range(40))
    # the ends are linked through a set that only a row without a key holds
    df = spark.createDataFrame([(1, near), (None, middle), (2, far)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_components(df).collect()) == [(0, 1), (1, 1), (2, 1)]
    df = spark.createDataFrame([(3, near), (7, near + " end"), (7, clean), (None, near), (7, None)], "doc_id long, text string")
    got = sorted(map(repr, map(tuple, without_near_duplicates(df).collect())))
    assert got == sorted(map(repr, [(3, near), (7, clean), (None, near), (7, None)]))


def test_hot_tokens_across_slices():
    """A token that is hot in one slice is so in all; its nodes come whichever slice they are in."""
    from collections import defaultdict

    texts = [f"a b c d e own{i} x{i} y{i} z{i} v{i}" for i in range(200)] + ["a b c d e"]
    got, parts = defaultdict(set), [texts[:100], texts[100:120], texts[120:]]
    by = defaultdict(list)
    for part in parts:
        for row in ngram_join._pack(part, 3).to_pylist():
            by[row["bucket"]].append(row)
    for rows in by.values():
        for r in ngram_join._count_bucket(pa.Table.from_pylist(rows)).to_pylist():
            got[r["token"]].add((r["node"], r["df"]))
    assert len(got) == 1
    (found,) = got.values()
    assert len(found) == 201 and {df for _, df in found} == {ngram_join.HOT}


def test_every_filter_is_needed_and_safe(spark, monkeypatch):
    """Pairs reach the comparison of sets only if prefixes meet under every order."""
    seen = []
    verify = ngram_join._verify

    def spy(pairs, sets):
        empty = F.array().cast("array<bigint>")
        seen.append(verify(pairs, sets).count() - verify(pairs, sets.withColumn("second", empty)).count())
        return verify(pairs, sets)

    monkeypatch.setattr(ngram_join, "_verify", spy)
    rows = [(i, " ".join(f"w{j + i % 3}" for j in range(60))) for i in range(6)]
    got = sorted(tuple(r) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and sum(seen) > 0


def test_long_text_and_extra_columns(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, "w " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(tuple(r) for r in ngram_components(df).collect())
    assert got == [(1, 99_996, 1), (2, 99_997, 1), (3, got[2][1], 3), (4, 1, 4)]


def test_boilerplate_makes_no_pairs(spark, monkeypatch):
    """Texts that share four fifths of their words have no links, and their lists end before any pair."""
    left = []
    open_members = ngram_join._open_members

    def spy(rows):
        kept = open_members(rows)
        left.append((rows.count(), kept.count()))
        return kept

    monkeypatch.setattr(ngram_join, "_open_members", spy)
    common = " ".join(f"c{i}" for i in range(240))
    rows = [(i, common + " " + " ".join(f"o{i}x{j}" for j in range(60))) for i in range(200)]
    # near copies of one of them still meet
    rows += [(1000 + i, rows[7][1] + f" end{i}") for i in range(3)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 7 if k >= 1000 else k for k, _ in rows}
    assert left and left[0][0] > 200 and left[0][1] <= 16


def test_size_classes_lose_no_link(spark):
    """Sizes from far below to far above each other: links across classes are found by lists alone."""
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[:n])) for n in range(60, 400, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_components(df).collect()) == brute(rows)
