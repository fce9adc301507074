import hashlib
import random
import zlib

import numpy as np
import tarn.llm.periodic as periodic
from pyspark.sql import functions as F
from tarn.llm.periodic import isolated, kept_words, measure, numbered, periodic_runs, planes, planted, run_digests, runs_of, runs_of_each, worth


def plain_runs(words):
    """Runs by the definition, with the smallest period of every stretch tested by itself."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            i = j
            if length >= max(12, 2 * q):
                part = words[start : start + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((start, length, q))
    return sorted(out)


def plain_words(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = None if key is None else zlib.crc32(str(key).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_row(key, text):
    words = plain_words(key, text)
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def made_of_repeats(r, n, kinds):
    words = []
    while len(words) < n:
        part = [str(r.randrange(kinds)) for _ in range(r.randrange(1, 12))]
        words += part * r.choice((1, 1, 2, 3, 6))
    return words[:n]


def test_random_words():
    r = random.Random(3)
    for n in (0, 1, 11, 12, 13, 24, 64, 65, 150):
        for kinds in (1, 2, 3, 8, 40):
            for _ in range(8):
                words = made_of_repeats(r, n, kinds)
                assert sorted(runs_of(numbered(words))) == plain_runs(words)


def test_texts_that_share_integers(monkeypatch):
    r = random.Random(5)
    texts = [made_of_repeats(r, r.randrange(0, 90), r.choice((1, 2, 9))) for _ in range(120)]
    for size in (1, 50, 300, 100_000):
        monkeypatch.setattr(periodic, "GROUP_WORDS", size)
        assert runs_of_each([numbered(t) for t in texts]) == [plain_runs(t) for t in texts]


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = run_digests(periodic_runs(planted(df.withColumn("runs", F.lit(1)).withColumn("h", F.lit(2))))).collect()
    assert len(got) == len(texts) and sum(r.n_runs for r in got) > 10
    for r in got:
        assert tuple(r)[1:] == plain_row(r.doc_id, texts[r.doc_id]), r.doc_id


def test_sieve_changes_nothing(monkeypatch):
    """The sieve of very long texts gives the runs that all lags give."""
    r = random.Random(8)
    cases = [made_of_repeats(r, n, k) for n in (200, 500) for k in (1, 2, 30) for _ in range(6)]
    long = [str(r.randrange(500)) for _ in range(90)]
    cases += [long * 5 + made_of_repeats(r, 200, 9), ["x"] * 700, ["x", "y"] * 300 + long + ["x", "y"] * 200]
    want = [sorted(runs_of(numbered(c))) for c in cases]
    monkeypatch.setattr(periodic, "SIEVE_WORDS", 12)
    monkeypatch.setattr(periodic, "SIEVE_LAG", 8)
    assert [sorted(runs_of(numbered(c))) for c in cases] == want
    assert any(q > 80 for runs in want for _, _, q in runs)


def test_sieve_passes_few_lags():
    r = random.Random(1)
    ids = numbered([str(int(r.paretovariate(0.8))) for _ in range(40_000)])
    assert sum(worth(ids, q, []) for q in range(33, 20_001)) < 2000  # of 19,968, although four words in ten are the same
    one = np.zeros(40_000, dtype=np.int64)
    assert not any(worth(one, q, [(0, 40_000, 1)]) for q in range(33, 500))


def test_very_long_text():
    r = random.Random(6)
    part = [str(r.randrange(10_000)) for _ in range(20_000)]
    words = [str(-k) for k in range(30_000)] + part * 3 + part[:100] + ["end"] * 20
    got = runs_of(numbered(words))
    assert sorted(got) == [(30_000, 60_100, 20_000), (90_100, 20, 1)]


def test_bits():
    ids = np.array([0, 5, 3, 7, 0])
    assert [[p >> i & 1 for i in range(5)] for p in planes(ids)] == [[0, 1, 1, 1, 0], [0, 0, 1, 1, 0], [0, 1, 0, 1, 0]]
    assert isolated(0b0111011110, 3) == 0b0001000000 | 0b0000000110
    assert kept_words(6, [(0, 4, 1), (2, 4, 2)]).tolist() == [True, False, False, False, False, False]


def test_odd_rows(spark):
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a " * 40), (4, "a " * 40), (None, "b\x0bc " * 9), (5, "é\x1cz " * 12), (6, "x"), (7, "l1 l2\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("w", F.lit(0))
    order = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in run_digests(periodic_runs(planted(df))).collect()), key=order)
    assert got == sorted(((k, *(plain_row(k, t) if t is None or len(t) < 5000 else fast_row(k, t))) for k, t in rows), key=order)
    assert run_digests(periodic_runs(planted(df.limit(0)))).count() == 0
    assert measure([None, "", "a b"])["n_words"] == [0, 0, 2]


def fast_row(key, text):
    """A text of one period throughout, told in closed form."""
    words = plain_words(key, text)
    assert words == [b"l1", b"l2"] * (len(words) // 2)
    return 1, 0, len(words), 2, 500 * len(words), hashlib.sha256(f"0,{len(words)},2\n".encode()).hexdigest(), hashlib.sha256(b"l1 l2").hexdigest()
