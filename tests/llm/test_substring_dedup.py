import random

from pyspark.sql import functions as F
from tarn.llm.registry import op8_substring_dedup
from tarn.llm.substring_dedup import LEAST_SENTENCES, LEAST_WORDS, LONE_WORDS, remove_repeats, sentences, spans


def plain_spans(forms):
    out = []
    for i in range(len(forms)):
        if len(forms[i].split()) >= LONE_WORDS:
            out.append((forms[i], i, i + 1))
        for j in range(i + LEAST_SENTENCES, len(forms) + 1):
            if sum(len(f.split()) for f in forms[i:j]) >= LEAST_WORDS:
                out.append(("\n".join(forms[i:j]), i, j))
                break
    return out


def brute(rows):
    first, out = {}, {}
    split = {d: sentences(t)[1] for d, t in rows if t is not None}
    for d in sorted(split):
        for s, a, _ in plain_spans(split[d]):
            first.setdefault(s, (d, a))
    for d, forms in split.items():
        gone = set()
        for s, a, b in plain_spans(forms):
            if first[s] != (d, a):
                gone |= set(range(a, b))
        out[d] = (len(forms), len(gone))
    return out


def test_sentences():
    starts, forms = sentences("One two.  Three!\n\nFour five? \n six")
    assert forms == ["one two.", "three!", "four five?", "six"] and starts[0] == 0
    assert sentences("") == ([0], []) and sentences(" \n ")[1] == []
    text = "\n\nA b. C d.\n... x"
    starts, forms = sentences(text)
    assert "".join(text[a:b] for a, b in zip(starts, starts[1:])) == text


def test_spans_match_plain():
    r = random.Random(3)
    for _ in range(200):
        forms = [" ".join("w" for _ in range(r.choice([1, 2, 5, 9, 14, 40]))) for _ in range(r.randint(0, 12))]
        assert [(a, b) for _, a, b in spans(forms)] == [(a, b) for _, a, b in plain_spans(forms)]


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = remove_repeats(df.withColumn("spans", F.lit(1)).withColumn("n_removed", F.lit("x")), closing=False).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in got} == want
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        assert r.text == texts[r.doc_id] if not r.n_removed else len(r.text) < len(texts[r.doc_id])


def test_passage_stays_once(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    sent = lambda: " ".join(word() for _ in range(r.randint(3, 12))).capitalize() + ". "
    passage = "".join(sent() for _ in range(9))
    rows = [(i, "".join(sent() for _ in range(4)) + (passage if i % 3 == 0 else "") + "".join(sent() for _ in range(4))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[1][1]), (103, "Hi. Hi. Hi."), (104, passage * 2)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), closing=False).collect()}
    assert sum(passage.strip() in (r.text or "") for r in got.values()) == 1 and passage in got[0].text
    assert got[1].text == rows[1][1] and got[102].text == "" and got[100].text is None and got[101].text == ""
    assert got[103].n_removed == 0 and got[104].text == "" and got[3].n_removed == 9
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def all_runs(rows):
    """(sentences, those gone) of each text when every run of the least size counts."""
    first, runs = {}, {}
    for d, t in sorted(rows):
        forms = sentences(t)[1]
        n = [len(f.split()) for f in forms]
        runs[d] = len(forms), [
            ("\n".join(forms[i:j]), i, j)
            for i in range(len(forms))
            for j in range(i + 1, len(forms) + 1)
            if (j - i >= LEAST_SENTENCES and sum(n[i:j]) >= LEAST_WORDS) or (j == i + 1 and n[i] >= LONE_WORDS)
        ]
        for s, i, _ in runs[d][1]:
            first.setdefault(s, (d, i))
    return {d: (n, {k for s, i, j in found if first[s] != (d, i) for k in range(i, j)}) for d, (n, found) in runs.items()}


def test_query_covers_all_runs(spark, tmp_path):
    r = random.Random(21)
    sent = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + ". "
    a, b, c, d = sent(20), sent(20), sent(5), sent(5)
    rows = [(k, a + b + c + d + sent(9) + sent(9)) for k in range(3)]
    pool = [sent(r.choice([1, 2, 3, 5, 9, 14, 40])) for _ in range(60)]
    for k in range(3, 60):
        text = ""
        for _ in range(r.randint(1, 6)):
            at = r.randrange(60)
            text += "".join(pool[at : at + r.randint(1, 9)]) + (sent(r.randint(1, 9)) if r.random() < 0.7 else "")
        rows.append((k, text))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert all(x not in got[k].text for k in (1, 2) for x in (a, b, c, d)) and got[1].n_removed == 4
    texts = dict(rows)
    for k, (n, gone) in all_runs(rows).items():
        starts, _ = sentences(texts[k])
        kept = "".join(texts[k][starts[i] : starts[i + 1]] for i in range(n) if i not in gone)
        assert (got[k].n_sentences, got[k].n_removed, got[k].text.strip()) == (n, len(gone), kept.strip())


def test_repeated_null_and_string_keys(spark):
    a = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi. "
    own = "Some words that no other text has at all here. More of those words, quite alone in this text. And a third."
    rows = [("1", a + "Tail."), ("1", own), ("1", own), (None, a + "Other end."), (None, None), ("2", a + "End."), ("0x", "")]
    got = sorted((r.k or "", r.t_in or "", r.text, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "k string, t string"), "k", "t").withColumn("t_in", F.col("text")).collect())
    # the row without a key comes first and stays; texts that share a key do not lose each other's sentences
    assert got == sorted((k, t or "", t, n) for k, t, n in [("", a + "Other end.", 0), ("", None, 0), ("0x", "", 0), ("1", own, 0), ("1", own, 0), ("1", "Tail.", 2), ("2", "End.", 2)])


def test_long_text_and_unspaced_script(spark):
    long = "".join(f"Sentence {i} of a very long text with words w{i} v{i}. " for i in range(20_000))
    han = "今日はとても良い天気ですね。明日もきっと晴れるでしょう。"  # a word for every character
    rows = [(1, long), (2, "Begin. " + long), (3, "".join("w " * 200_000)), (4, "前文です。" + han), (5, han + "後文です。")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == long and got[2].text == "Begin." and got[2].n_removed == 20_000
    assert got[3].n_removed == 0 and got[4].n_removed == 0 and got[5].text == "後文です。"
