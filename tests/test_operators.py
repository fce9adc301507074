"""Worked examples and properties of the operators."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from tarn import api, schemas
from tarn.functions import decisions as D
from tarn.functions import text as T
from tarn.functions import urls as U
from tarn.operators import bloom, chunking, japanese, leases, robots
from tarn.operators import search as S
from tarn.operators.html_record import parse
from tarn.sources import stores
from tarn.streaming import pipelines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Example.COM:80/A/B/?b=2&a=1&a=0&c=#frag", "http://example.com/A/B?a=0&a=1&b=2&c="),
        ("https://example.com", "https://example.com/"),
        ("https://example.com//", "https://example.com"),
        ("https://h.com/p;v=1/?z", "https://h.com/p;v=1?z="),
        ("ftp://h/x", None),
        (None, None),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, U.normalize(F.lit(url).cast("string"))) == want
    assert one(spark, U.normalize_exact(F.lit(url).cast("string"))) == want


def test_urls(spark):
    assert one(spark, U.normalize_exact(F.lit("https://h.com/p?q=a b&x=%E3%81%82"))) == "https://h.com/p?q=a+b&x=%E3%81%82"
    assert one(spark, U.url_hash(F.lit("https://example.com"))) == "0f115db062b7c0dd030b16878c99dea5c354b49dc37b38eb8846179c7783e9d7"
    assert one(spark, U.domain(F.lit("http://user@h:1/x"))) == "user@h" and one(spark, U.domain(F.lit("nothing"))) is None
    assert one(spark, U.depth(F.lit("http://h/a//b/"))) == 3 and one(spark, U.depth(F.lit("http://h"))) == 0
    assert one(spark, U.resolve(F.lit("http://h/a/b"), F.lit("../c"))) == "http://h/c"
    assert one(spark, U.resolve(F.lit("http://h/a/b"), F.lit("mailto:x"))) is None
    assert one(spark, U.is_address(F.lit("10.0.0.255"))) and not one(spark, U.is_address(F.lit("256.1.1.1")))


def test_text(spark):
    assert len(one(spark, T.truncated(F.lit("ab " * 5000)))) == 8189
    assert len(one(spark, T.truncated(F.lit("x" * 9000)))) == 8192
    assert one(spark, T.title([F.lit("  ")], F.lit("http://h/some-page_one"))) == "Some Page One"
    assert one(spark, T.keywords(F.lit("Python Web Guide: API 2024 - Home"), F.lit(None).cast("string"))) == ["API 2024 - H"]
    assert "Python Web Guide" in one(spark, T.keywords(F.lit("Python Web Guide: API 2024 - Home"), F.lit("some text"), mode="intended"))
    assert one(spark, T.categories(F.lit("x"), F.lit("capital gains"), F.lit("github.com"))) == ["software", "technology"]
    assert one(spark, T.is_japanese(F.lit("これは日本語です"))) and not one(spark, T.is_japanese(F.lit("plain")))
    dates = F.array(F.lit("nope"), F.lit("25/12/2023"))
    assert str(one(spark, T.published_at(dates)))[:10] == "2023-12-25"
    assert one(spark, T.sitemap_priority(F.lit("7"))) == 1.0 and one(spark, T.sitemap_priority(F.lit("x"))) is None


def test_decisions(spark):
    assert [one(spark, D.backoff(F.lit(r))) for r in (0, 1, 9)] == [60, 120, 3600]
    assert one(spark, D.dlq_delay(F.lit(20))) == 300
    for kind, status, name, again in [("robots", 200, "robots_blocked", False), (None, 404, "http_error", False), (None, 429, "rate_limited", True), (None, 503, "http_error", True), ("timeout", None, "timeout", True), (None, None, "unknown", True)]:
        e = D.classify(F.lit(kind).cast("string"), F.lit(status).cast("int"))
        assert one(spark, e["error_type"]) == name and one(spark, D.should_retry(e, F.lit(1))) == again
    assert one(spark, D.valid_transition(F.lit("done"), F.lit("pending"))) and not one(spark, D.valid_transition(F.lit("done"), F.lit("failed")))
    assert one(spark, D.index_priority(F.lit("example.com"), F.lit(-1), F.lit("a long title"), F.lit("d"), F.lit("en"))) == 19


def cut(spark, strategy, text, *how):
    df = spark.createDataFrame([(text,)], "t string")
    return [tuple(c) for c in df.select(strategy(F.col("t"), *how).alias("c")).first().c]


def test_normalize_equals_the_library_form(spark):
    """Generated URLs with equals signs, escapes, plus signs, blanks and repeated names: both forms agree, and no value is lost."""
    r = random.Random(7)
    parts = ["a", "b=", "=", "==", "%3D", "%", "%4", "%zz", "+", " ", "~", "*", "&", "&&", "é", "%C3%A9", "%c3", ";", "x=1", "q=a=b", "q=c=b", "/", ":", "@", "-._"]
    urls = ["http://h.com/p?" + "".join(r.choice(parts) for _ in range(r.randrange(0, 9))) for _ in range(600)]
    urls += [" \tHTTPS://H.com:443/a//\n", "http://h.com:80?x", "https://h.com:80/#f", "ftp://h.com", "http://", "", "http://h.com/a b?c d", "http://h.com/\ta"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select("u", U.normalize(F.col("u")).alias("a"), U.normalize_exact("u").alias("b")).collect()
    assert [(x.u, x.a) for x in rows if x.a != x.b] == []
    hashes = [one(spark, U.url_hash(F.lit(u))) for u in ("http://h.com/p?q=a=b", "http://h.com/p?q=c=b", "http://h.com/p?q=b")]
    assert len(set(hashes)) == 3
    assert one(spark, U.normalize(F.lit("https://h.com/p?t=abc==&q=a b"))) == "https://h.com/p?q=a+b&t=abc%3D%3D"


def test_chunks(spark):
    spans = [c[2:4] for c in cut(spark, chunking.fixed, "abcd efgh ijkl mnop qrst", 10, 3)]
    assert spans == [(0, 10), (7, 17), (14, 24)]
    assert len(cut(spark, chunking.fixed, "a" * 20, 5, 5)) == 16
    told = "One two three. Four five six! Seven eight nine? Ten."
    got = cut(spark, chunking.by_sentence, told, 20, 4)
    assert [c[0] for c in got] == ["One two three", "hree Four five six", "six Seven eight nine", "nine Ten."]
    assert [c[2] for c in got] == [0] * 4 and [c[3] for c in got] == [13, 18, 21, 9]
    assert [c[0] for c in cut(spark, chunking.by_sentence, told, 20, 0)] == ["One two three", "One two three Four five six", "One two three Four five six Seven eight nine", "One two three Four five six Seven eight nine Ten."]
    text = "".join(random.Random(1).choice("abc d. ") for _ in range(500))
    covered = set()
    for c in cut(spark, chunking.fixed, text, 50, 10):
        covered |= set(range(c[2], c[3]))
    assert covered == set(range(len(text)))
    japanese_text = "これは日本語の文章です" * 5
    got = cut(spark, chunking.semantic, japanese_text, 20, 0)
    assert {c[4] for c in got} == {"ja"} and all(len(c[0]) <= 20 for c in got) and "".join(c[0] for c in got).replace(" ", "") == japanese_text
    assert [c[0] for c in cut(spark, chunking.by_sentence, "一つの文。\u3000二つ目の文！三つ目？", 8, 2)] == ["一つの文", "の文 二つ目の文", "の文 三つ目"]
    assert cut(spark, chunking.chunks, "short", "nonsense") == [("short", 0, 0, 5, "unknown")]


def test_rrf(spark):
    lex = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "doc string, bm25_rank long")
    vec = spark.createDataFrame([("c", 1), ("d", 2), ("a", 3)], "doc string, vec_rank long")
    rows = S.rrf(lex, vec, 10).collect()
    assert [r.doc for r in rows] == ["a", "c", "b", "d"]
    assert rows[0].rrf == pytest.approx(0.03226646, abs=1e-8) and rows[2].rrf == pytest.approx(0.03175403, abs=1e-8)


def test_bloom(spark):
    assert bloom.sizes(1_000_000, 1e-3) == (10, 1_437_759)
    a, b = spark.range(0, 300).withColumnRenamed("id", "v"), spark.range(200, 500).withColumnRenamed("id", "v")
    fa, fb = (bloom.build(x, "v", 1000, 0.01) for x in (a, b))
    seen = lambda f, df: {r.v for r in bloom.probe(df, "v", f, 1000, 0.01).where("maybe").collect()}
    every = spark.range(0, 2000).withColumnRenamed("id", "v")
    assert seen(fa, a) == set(range(300)) and len(seen(fa, every)) < 300 + 60
    assert seen(bloom.union(fa, fb), every) >= set(range(500))
    assert set(range(200, 300)) <= seen(bloom.intersection(fa, fb), every) and len(seen(bloom.intersection(fa, fb), every)) < 250


def test_robots(spark):
    files = spark.createDataFrame([("h.com", "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /\n\nUser-agent: *\nDisallow:\nCrawl-delay: 3\nSitemap: https://h.com/s.xml")], "domain string, robots string")
    r = robots.rules(files)
    urls = spark.createDataFrame([("http://h.com/x/1",), ("http://h.com/y",), ("http://other.com/x",)], "url string")
    assert [x.allowed for x in robots.can_fetch(urls, r, "A").orderBy("url").collect()] == [False, True, True]
    assert [x.allowed for x in robots.can_fetch(urls, r, "zzz").orderBy("url").collect()] == [True, True, True]
    assert one(spark, robots.sitemap_lines(F.lit("x\nSiteMap: https://h/s.xml"))) == ["https://h/s.xml"]


def test_html_record():
    page = """<html lang="en"><head><meta property="og:title" content="T"><meta name="date" content="2024-01-02"><script type="application/ld+json">{"a": 1}</script></head>
    <body><nav><a href="/menu">m</a></nav><div class="ads">x</div><article><p>%s</p><a href="/a?b=1">link</a><img src="i.png" alt="A"></article></body></html>""" % ("word " * 30)
    r = parse(page, "http://h.com/p")
    assert r["title"] == "T" and r["html_lang"] == "en" and r["publication_dates"] == ["2024-01-02"] and r["structured"] == []
    assert r["links"] == [{"url": "http://h.com/a?b=1", "text": "link", "domain": "h.com"}] and r["images"][0]["url"] == "http://h.com/i.png"
    assert r["body_text"].startswith("word word") and "x" not in r["body_text"].split()
    full = parse(page, "http://h.com/p", "intended")
    assert full["total_links"] == 2 and full["structured"] == ['{"a": 1}']
    assert parse("", "")["body_text"] == "" and parse("<p>" * 3000, "u")["total_links"] == 0


def test_japanese(spark):
    rows = spark.createDataFrame([("東京都庁は日本のTokyoにある",)], "t string").select(japanese.analyze(F.col("t")).alias("k"))
    r = rows.select(japanese.keywords(F.col("k"), 3).alias("kw"), japanese.normalized(F.col("k")).alias("n")).first()
    assert r.kw[0] == "東京都庁" and "日本" in r.n
    assert one(spark, japanese.fallback_keywords(F.lit("東京 abc ab ABC"), 5)) == ["abc", "東京"]


LEASE_EVENTS = "key long, at long, seq long, kind string, owner string"


def lease_rows(seed, keys, many, apart):
    r = random.Random(seed)
    kinds = ["acquire", "heartbeat", "done", "failed", "retry", "release", "other"]
    return [(k, n * apart + r.randrange(apart), n, r.choice(kinds), r.choice(["w1", "w2", None])) for k in range(keys) for n in range(many)]


def replay(rows, as_of=None):
    """The lease of each key after its events, one by one."""
    out = {}
    for key in {r[0] for r in rows}:
        s, applied = leases.START, 0
        for _, at, _, kind, owner in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            new, ok = leases.step(s, at, kind, owner)
            swept = s[0] == "in_progress" and s[2] <= at
            if ok and kind != "heartbeat":
                assert new[0] in D.TRANSITIONS["pending" if swept else s[0]]
            s, applied = new, applied + ok
        if as_of is not None and s[0] == "in_progress" and s[2] <= as_of:
            s = ("pending", None, None, s[3])
        out[key] = (*s, applied)
    return out


@pytest.mark.parametrize("size", [9, 1000])
def test_lease_fold_in_parts(spark, size):
    """Parts of any size give what a replay gives, and a hot key is folded in parts."""
    rows = lease_rows(5, 4, 40, 700) + [(9, at, seq, kind, "w") for _, at, seq, kind, _ in lease_rows(6, 1, 120, 40)]
    df = spark.createDataFrame(rows, LEASE_EVENTS)
    got = {r.key: tuple(r)[1:] for r in leases.fold(df, size=size).collect()}
    assert got == replay(rows)
    if size == 9:
        assert leases.parts(df, size).where("key = 9").count() > 8
        assert {r.key: tuple(r)[1:] for r in leases.fold(df, as_of=10**6, size=size).collect()} == replay(rows, 10**6)
    assert leases.fold(df.limit(0)).count() == 0


def test_leases_in_a_stream(spark, tmp_path):
    """Two batches and timers: states equal the fold's, leases run out without an event, finished keys are forgotten."""
    rows = lease_rows(4, 6, 40, 900)
    end = max(r[1] for r in rows)
    # key 50 holds a lease that nothing ends; key 60 is done and its state is dropped, so it begins anew
    rows += [(50, end - 5000, 0, "acquire", "w1"), (60, 10, 0, "acquire", "w1"), (60, 20, 1, "failed", "w1"), (60, 30, 2, "acquire", "w1"), (60, 40, 3, "done", "w1")]
    df = spark.createDataFrame(rows, LEASE_EVENTS)
    for part in (F.col("at") < end // 2, F.col("at") >= end // 2):
        df.where(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    again = (60, end + 9000, 4, "acquire", "w2")
    spark.createDataFrame([again, (99, end + 10_000, 0, "none", "none")], LEASE_EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(LEASE_EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    states = leases.fold_stream(stream, retention=3600)
    q = states.writeStream.foreachBatch(lambda b, n: b.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / "out" / str(n)))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert not q.exception()
    found = spark.read.parquet(str(tmp_path / "out" / "*")).orderBy("n", F.col("cause") == "expiry").collect()
    got = {r.key: (r.state, r.owner, r.ttl, r.retries) for r in found}
    want = {k: v[:4] for k, v in replay([r for r in rows if r[0] != 60], end + 10_000).items()}
    assert {k: got[k] for k in want} == want
    assert got[50] == ("pending", None, None, 0) and [r.cause for r in found if r.key == 50] == ["event", "expiry"]
    # without its old state the key has no failed try behind it
    assert [(r.state, r.retries) for r in found if r.key == 60] == [("done", 1), ("in_progress", 0)]


def test_previous_event(spark):
    """Across hours without events, with ties, and for a hot key: the event before is the one before."""
    from tarn.operators.rates import previous

    r = random.Random(9)
    rows = [(r.choice("aab"), r.randrange(0, 40) * r.choice((1, 3_600_000_000)), k, r.choice((None, "x", "y"))) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v string")
    got = {x.seq: x.before for x in previous(df, "k", "t", "seq", F.col("v"), "before").collect()}
    last, want = {}, {}
    for key, _, seq, v in sorted(rows, key=lambda x: (x[1], x[2])):
        want[seq] = last.get(key)
        last[key] = v
    assert got == want


def test_admission(spark):
    rows = [("d", s, i) for i, s in enumerate([0] * 70 + [30] * 5 + [60] * 3 + [61] * 80)]
    df = spark.createDataFrame(rows, "key string, sec long, seq long")
    got = {r.seq: r.admitted for r in leases.admissions(df).collect()}
    passed = []
    for _, sec, seq in rows:
        ok = sum(1 for s in passed if s > sec - 60) < 60
        assert got[seq] == ok, seq
        if ok:
            passed.append(sec)


def test_ingest(spark, tmp_path):
    lines = ['{"url": "http://a/x", "retry_count": 0}', "not json", '{"url": "http://b/x", "retry_count": 5}', '{"url": "http://c/x"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in/m.txt").write_text("\n".join(lines))
    schema = schemas.StructType.fromDDL("url string, retry_count int")
    q = pipelines.ingest(spark.readStream.text(str(tmp_path / "in")), schema, lambda d: d.withColumn("id", U.document_id(F.col("url"))), str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "c"))
    q.awaitTermination()
    assert {r.url for r in spark.read.parquet(str(tmp_path / "good")).collect()} == {"http://a/x", "http://c/x"}
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2


def test_windows_and_sessions(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "e"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    for k, df in enumerate((pipelines.windowed_counts(src, "ts", "user_id", "1 hour", "1 hour"), pipelines.sessions(src, "ts", "user_id"), pipelines.rotating_dedup(src, "ts", "user_id"))):
        q = df.writeStream.format("memory").queryName(f"w{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"w{k}").count() > 0


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k long, v string, t long")
    assert sorted(r.v for r in stores.upsert(old, new, "k", "t").collect()) == ["a", "c", "d"]
    assert sorted(r.v for r in stores.put_if_absent(old, new, "k").collect()) == ["a", "b", "d"]
    assert sorted(r.v for r in stores.update_where(old, F.col("k") == 1, {"v": F.lit("z")}).collect()) == ["b", "z"]
    assert [r.k for r in stores.delete_keys(old, new, "k").collect()] == [1]
    df = spark.createDataFrame([("http://h.com/x", "2024-02-03 00:00:00", "body")], "url string, fetched_at string, content string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    stores.write_objects(df, str(tmp_path / "o"))
    row = stores.read_objects(spark, str(tmp_path / "o"), F.col("domain") == "h.com").first()
    assert row.content == "body" and row.month in ("02", "2") and row.bytes == 4
    good, bad = stores.decode(spark.createDataFrame([("{}",), ("x",)], "value string"), "value", schemas.schema("crawl_result"))
    assert good.count() == 1 and bad.count() == 1
    stores.write_messages(old, str(tmp_path / "m"))
    assert stores.read_messages(spark, str(tmp_path / "m"), old.schema).where("k = 2").count() == 1


def test_api(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("doc"), "text", "lang", F.col("source").alias("site"))
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("doc"), "embedding")
    service = api.SearchService(docs, vectors)
    hits = service.search(api.SearchQuery("the tion", size=5, lang="en")).collect()
    assert len(hits) == 5 and all(h.lang == "en" for h in hits)
    assert service.suggest("erthe", 5) and service.health()["status"] == "green"
    with pytest.raises(ValueError):
        api.SearchQuery("", page=0)
    page = service.respond(api.SearchQuery("the tion", size=5, lang="en"))
    assert page.total >= 5 and [h["doc"] for h in page.hits] == [h.doc for h in hits] and (page.page, page.size) == (1, 5)
    # an index that is gone gives an empty page, not an error
    service.close()
    gone = service.respond(api.SearchQuery("the", page=2))
    assert (gone.total, gone.hits, gone.page) == (0, [], 2)
    for wrong in ({"per_domain": 50}, {"max_backoff": 1.0}, {"heartbeat": 3600}, {"qps_overrides": {"a.com": 0}}, {"rate_store": ""}, {"max_retries": -1}, {"chunk_overlap": 8000}, {"timeout": 0}, {"store": ""}):
        with pytest.raises(ValueError):
            api.Settings(**wrong)
    assert api.Settings(lease=50).problems() == ([], ["lease is under a minute"]) and api.Settings(limit_rates=False, rate_store="").problems() == ([], [])
    assert api.expand({"a": ["${NONE_SUCH:x}"]}, {}) == {"a": ["x"]}
    assert "url?: string;" in schemas.to_typescript("crawl_result")
    assert SimpleNamespace(**schemas.constraints("crawl_message")).priority is not None
    assert re.match(r"\{", schemas.schema("url_state").json())


def test_language_codes(spark):
    from tarn.operators.language import detected, language_code

    given = {"a": ("en", 0.9), "b": ("en", 0.69), "c": ("zh-tw", 0.7), "d": ("sv", 0.99), "e": (None, 0.0), "x" * 10_000: ("fr", 1.0)}
    df = spark.createDataFrame([(t,) for t in [*list(given)[:-1], "x" * 10_001, "  \n", None]], "t string")
    found = df.select(detected(F.col("t"), lambda texts: [given[t] for t in texts]).alias("f"))
    got = found.select("f.code", language_code(F.col("f")).alias("w"), language_code(F.col("f"), "intended").alias("i"), language_code(F.col("f"), "intended", "en", 0.95).alias("o")).collect()
    assert [tuple(r) for r in got] == [
        ("en", None, "en", "en"),
        ("en", "ja", "ja", "en"),
        ("zh-tw", None, "zh", "en"),
        ("sv", "ja", "ja", "en"),
        (None, "ja", "ja", "en"),
        ("fr", None, "fr", "fr"),
        (None, "ja", "ja", "en"),
        (None, "ja", "ja", "en"),
    ]


def test_language_profiles(spark):
    from tarn.operators.language import by_profiles
    from tarn.plans.catalog import QUERIES

    said = {"Il gatto è sul tavolo e non vuole scendere": "it", "O gato está na mesa e não quer descer": "pt", "これはペンです。": "ja", "人人生而自由": "zh-cn", "모든 인간은": "ko", "Привет мир": "ru", "مرحبا بالعالم": "ar", "नमस्ते": "hi", "12 34": None}
    assert [c for c, _ in by_profiles(list(said))] == list(said.values())
    rows = QUERIES["language_detect_intended"](spark, "/root/testdata/sf0.001").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(lang) and sum(r.lang == lang[r.doc_id] for r in rows) >= 0.98 * len(rows)


def test_highlight_and_fragments(spark):
    from tarn.operators import search as S

    def run(text, terms):
        df = spark.createDataFrame([(text,)], "t string")
        r = df.select(S.highlight(F.col("t"), terms).alias("h"), S.fragments(F.col("t"), terms).alias("f")).first()
        return r.h, r.f

    # a hit at the edge of 150 characters is not lost
    assert run("x" * 147 + " the end", ["the"])[1] == ["x" * 72 + " <em>the</em> end"] or "<em>the</em> end" in run("x" * 147 + " the end", ["the"])[1][0]
    assert run("c++ and c, (a) or a.", ["c++", "(a)"])[0] == "<em>c++</em> and c, <em>(a)</em> or a."
    assert run("The theory, THE end", ["the"])[0] == "<em>The</em> theory, <em>THE</em> end"
    assert run(r"a \E b", ["\\E"])[0] == r"a <em>\E</em> b"
    r = random.Random(4)
    for _ in range(20):
        words = [r.choice(["the", "and", "theory", "lathe", "word", "l" * 40]) for _ in range(120)]
        text = " ".join(words)
        _, found = run(text, ["the"])
        assert len(found) <= 3 and all("<em>the</em>" in f for f in found)
        at = 0
        for f in found:
            plain = f.replace("<em>", "").replace("</em>", "")
            # stretches of the text, in order, without overlap, of about the asked size
            at = text.index(plain, at) + len(plain)
            assert len(plain) <= 2 * 150
        assert bool(found) == ("the" in words)
    assert run("nothing here", ["the"]) == ("nothing here", [])


def test_blank_chunks_are_left_out(spark):
    got = cut(spark, chunking.fixed, "abc" + " " * 60 + "def", 10, 2)
    assert [c[0] for c in got if not c[0]] == [] and got[0][0] == "abc" and got[-1][0].endswith("def")
    assert [c[1] for c in got] == list(range(len(got)))
    # ends of sentences alone leave nothing
    assert cut(spark, chunking.chunks, "?! " * 5000) == []
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(chunking.chunks(F.col("t")).alias("c")).first().c[0].content is None


def test_search_orders_and_japanese(spark, tmp_path):
    rows = [
        (1, "red apples and pears", "en", "s", "apples", "fruit", "2024-01-01", 1.0),
        (2, "apples", "en", "s", "none", "fruit", "2024-03-01", 3.0),
        (3, "many red apples apples", "en", "t", "red", "colour", None, None),
        (4, "東京都の天気は晴れ", "ja", "s", "天気", "", "2024-02-01", 2.0),
        (5, "aples", "en", "s", "x", "y", "2020-01-01", 0.0),
    ]
    docs = spark.createDataFrame(rows, "doc long, text string, lang string, site string, title string, keywords string, published_at string, popularity_score double")
    service = api.SearchService(docs)
    hits = lambda q, **k: [r.doc for r in service.search(api.SearchQuery(q, **k)).collect()]
    assert hits("apples")[0] == 1 and set(hits("apples")) == {1, 2, 3, 5}  # the title counts most; a near word is found too
    assert hits("apples", sort="published_at") == [2, 1, 5, 3] and hits("apples", sort="popularity_score") == [2, 1, 5, 3]
    assert hits("apples", page=2, size=2, sort="published_at") == [5, 3]
    assert hits("天気") == [4]
    assert "fruit" in service.suggest("fruti") and service.search(api.SearchQuery("red")).first().fragments
    assert service.stats()["content"]["documents"] == 5
    service.close()


def test_kept_tables_follow_their_source(spark, tmp_path):
    from tarn.sources.shared import kept_tables

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    write = lambda: {"n": lambda to: spark.read.parquet(path).write.parquet(to)}
    first = kept_tables(spark, "x", path, write)["n"]
    assert kept_tables(spark, "x", path, write)["n"] == first and spark.read.parquet(first).count() == 3
    import time

    time.sleep(0.1)
    spark.range(5).write.mode("overwrite").parquet(path)
    again = kept_tables(spark, "x", path, write)["n"]
    assert again != first and spark.read.parquet(again).count() == 5


def test_peak_concurrency_over_midnight(spark, tmp_path):
    from tarn.plans.catalog import QUERIES

    rows = [(1, "2024-01-01 23:59:50", 20.0), (2, "2024-01-01 23:59:55", 30.0), (3, "2024-01-02 00:00:05", 1.0), (4, "2024-01-03 12:00:00", 1.0)]
    df = spark.createDataFrame([(i, i, t, v) for i, t, v in rows], "event_id long, user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = {str(r.day): r.peak for r in QUERIES["peak_concurrency"](spark, str(tmp_path)).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 3, "2024-01-03": 1}


def test_bloom_growth_files_and_capacity(spark, tmp_path):
    from tarn.operators import bloom

    assert bloom.sizes(1_000_000, 0.001) == (10, 1_437_759)
    sizes = bloom.layer_sizes(1000, 100, 0.01)
    assert sum(n for n, _ in sizes) >= 1000 > sum(n for n, _ in sizes[:-1]) and sum(e for _, e in sizes) < 0.01
    df = spark.range(200).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(bloom.CapacityError):
        bloom.build_checked(df, "v", 100, 0.01)
    bloom.save(bloom.build_checked(df, "v", 200, 0.01), str(tmp_path / "f"), 200, 0.01)
    f, n, e = bloom.load(spark, str(tmp_path / "f"))
    assert bloom.probe(df, "v", f, n, e).where("not maybe").count() == 0
    df.write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        bloom.load(spark, str(tmp_path / "other"))


def test_generations_forget(spark):
    from tarn.streaming.pipelines import generations

    rows = [("a", 0), ("a", 5), ("b", 15), ("a", 25), ("a", 35), ("b", 46), ("c", 50)]
    df = spark.createDataFrame(rows, "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    got = {(r.k, r.s): r.seen for r in generations(df, "t", "k", 10).collect()}
    # with three generations of ten seconds a key is forgotten after the second one that follows
    assert got == {("a", 0): False, ("a", 5): True, ("b", 15): False, ("a", 25): True, ("a", 35): True, ("b", 46): False, ("c", 50): False}
