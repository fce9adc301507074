"""Writers and readers in round trips, index documents, dead letters, charsets and hand-made fixtures."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import decisions as D
from tarn.functions import text as T
from tarn.functions import urls as U
from tarn.operators import documents as O
from tarn.operators import robots
from tarn.plans.document_queries import CATEGORIES, CRAWL, PRIORITY, SAYING, crawl, said
from tarn.plans.registry import query, table
from tarn.plans.url_queries import DOMAIN
from tarn.sources import stores
from tarn.sources.queues import Queue
from tarn.sources.shared import shared_folder
from tarn.sources.versioned import VersionedTable


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("content"), F.lit("2024-02-03 04:05:06").cast("timestamp").alias("fetched_at"))


@query("object_round_trip", f"select {DOMAIN} as domain, count(*) as n, cast(sum(octet_length(encode(html))) as bigint) as bytes, cast(sum(case when octet_length(encode(html)) > 1024 then 1 else 0 end) as bigint) as packed, true as intact from pages group by 1")
def object_round_trip(spark, sf_dir):
    """Pages as objects by date and domain, gzip above 1024 bytes, and read back with their digests checked."""
    path = _place(spark, "objects")
    stores.write_objects(_pages(spark, sf_dir), path)
    back = stores.read_objects(spark, path, F.col("year") == "2024")
    return back.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("encoding") == "gzip").alias("packed"), F.min(F.md5("content") == F.col("content_md5")).alias("intact"))


@query("binary_objects", "select cast(page_id % 4 as int) as part, cast(sum(octet_length(encode(url)) + 1) as bigint) as bytes from pages group by 1")
def binary_objects(spark, sf_dir):
    """Whole files as bytes: URL lists written as text and read back file by file."""
    path = _place(spark, "binary")
    rows = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 4).cast("int").alias("part"))
    rows.repartition(4, "part").write.partitionBy("part").text(path)
    files = stores.read_binary(spark, path + "/*/*.txt")
    return files.groupBy(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part")).agg(F.sum("length").alias("bytes"))


@query("message_round_trip", "select page_id, url from pages")
def message_round_trip(spark, sf_dir):
    """Messages written one a line and read back by their schema; malformed lines would keep their text apart."""
    path = _place(spark, "messages")
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    stores.write_messages(rows, path)
    return stores.read_messages(spark, path, rows.schema).where(f"{stores.BAD} is null").select("page_id", "url")


@query("message_stream", "select count(*) as n, count(distinct url) as urls from pages")
def message_stream(spark, sf_dir):
    """The same messages as a stream that takes what is there and ends."""
    path, out = _place(spark, "messages"), _place(spark, "sink")
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    stores.write_messages(rows.repartition(4), path)
    stream = stores.read_messages(spark, path, rows.schema, stream=True, most_files=2)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", _place(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


@query("conditional_update", "select event_id, case when event_type = 'error' then 'retry' else event_type end as event_type, case when event_type = 'error' then value + 1 else value end as value from events")
def conditional_update(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return stores.update_where(e, F.col("event_type") == "error", {"event_type": F.lit("retry"), "value": F.col("value") + 1})


@query("delete_keys", "select user_id, count(*) as n from events where user_id not in (select user_id from events where event_type = 'error') group by 1")
def delete_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return stores.delete_keys(e, e.where("event_type = 'error'").select("user_id").distinct(), "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "batch_write_counts",
    "select cast(event_id // 25 as bigint) as batch, cast(sum(case when event_type <> 'error' then 1 else 0 end) as bigint) as written, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as refused from events group by 1",
)
def batch_write_counts(spark, sf_dir):
    """Batches of 25 puts that must not replace anything, into a table that has the errors already: what was written and what refused."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    t = VersionedTable.create(e.where("event_type = 'error'"), _place(spark, "puts"), "event_id", 8)
    out = t.update(e.withColumn("expected", F.lit(None).cast("long")))
    refused = out.refused.select("event_id", F.lit(1).alias("no"))
    per = e.join(refused, "event_id", "left").groupBy(F.expr("event_id div 25").alias("batch"))
    return per.agg(F.count_if(F.col("no").isNull()).alias("written"), F.count("no").alias("refused"))


@query(
    "conditional_writes",
    """select c_custkey, case when c_nationkey < 10 then 'MOVED' else c_mktsegment end as segment, round(case when c_acctbal < 0 then null when c_mktsegment = 'BUILDING' then c_acctbal + 10 else c_acctbal end, 2) as balance,
    cast(1 + case when c_mktsegment = 'BUILDING' then 1 else 0 end + case when c_nationkey < 10 then 1 else 0 end + case when c_acctbal < 0 then 1 else 0 end as bigint) as version from customer""",
)
def conditional_writes(spark, sf_dir):
    """Two writers that have read the same version of their rows: the second is refused where the first was, reads again and succeeds; then columns are removed."""
    c = table(spark, sf_dir, "customer")
    t = VersionedTable.create(c.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance")), _place(spark, "customers"), "c_custkey", 8)
    one = F.lit(1).cast("long").alias("expected")
    first = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", one, (F.col("c_acctbal").cast("double") + 10).alias("balance"))
    second = c.where("c_nationkey < 10").select("c_custkey", one, F.lit("MOVED").alias("segment"))
    t.update(first)
    refused = t.update(second).refused
    now = lambda: t.read().select("c_custkey", F.col("version").alias("expected"))
    t.update(refused.drop("expected").join(now(), "c_custkey"))
    t.update(c.where("c_acctbal < 0").select("c_custkey", F.array(F.lit("balance")).alias("removes")).join(now(), "c_custkey"))
    return t.read().select("c_custkey", "segment", F.round("balance", 2).alias("balance"), "version")


@query(
    "queue_redelivery",
    """select page_id, cast(case when page_id % 3 = 0 then 2 else 1 end as int) as deliveries from pages""",
)
def queue_redelivery(spark, sf_dir):
    """Every page as a message: two thirds are acknowledged, the others come again after the time-out, and only they."""
    p = table(spark, sf_dir, "pages")
    q = Queue(spark, _place(spark, "queue"), visibility=30, buckets=8)
    q.send(p.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("body"), F.create_map(F.lit("kind"), F.lit("page")).alias("attributes")), 0)
    everything = p.count()
    first = q.receive(1, everything)
    q.acknowledge(first.where(F.col("id").cast("long") % 3 != 0))
    early = q.receive(2, everything).select("id", "received")
    again = q.receive(40, everything).select("id", "received")
    every = first.select("id", "received").unionByName(early).unionByName(again)
    return every.groupBy(F.col("id").cast("long").alias("page_id")).agg(F.max("received").alias("deliveries"))


BASE = f"""select page_id, url, domain, body, status, {PRIORITY} as priority, lang, case when page_id % 2 = 0 then [domain, lang] else [] end as words from c"""


@query(
    "index_document",
    f"""with {CRAWL}, b as ({BASE}), j as (select page_id, words, cast(to_json(struct_pack(url := url, url_hash := sha256(url), domain := domain, title := lang, content := coalesce(body, ''), content_type := 'html', language := lang,
 fetched_at := '2024-02-03T04:05:06+00:00', indexed_at := '2024-02-03T04:05:07.250000+00:00', content_length := length(coalesce(body, '')), processing_priority := priority, status_code := status, raw_s3_key := 'raw/' || page_id, parsed_s3_key := '')) as varchar) as js from b)
 select page_id, md5(case when len(words) > 0 then left(js, length(js) - 1) || ',"keywords":' || cast(to_json(words) as varchar) || '}}' else js end) as document from j""",
)
def index_document(spark, sf_dir):
    """All fields of an index document; keywords only where there are any, no embedding, no categories."""
    c = crawl(spark, sf_dir)
    body = F.coalesce("body", F.lit(""))
    words = F.when(F.col("page_id") % 2 == 0, F.array("domain", "lang")).otherwise(F.array().cast("array<string>"))
    at = F.lit("2024-02-03 04:05:06").cast("timestamp")
    doc = O.index_document(
        {
            "url": F.col("url"),
            "url_hash": F.sha2("url", 256),
            "domain": F.col("domain"),
            "title": F.col("lang"),
            "content": body,
            "language": F.col("lang"),
            "fetched_at": O.iso(at),
            "indexed_at": O.iso(at + F.expr("interval 1250 milliseconds")),
            "content_length": F.length(body),
            "processing_priority": D.index_priority(F.col("domain"), F.col("age"), F.col("title"), F.col("description"), F.col("lang")),
            "status_code": F.col("status"),
            "raw_s3_key": F.concat(F.lit("raw/"), F.col("page_id").cast("string")),
            "keywords": words,
            "categories": F.array().cast("array<string>"),
        }
    )
    return c.select("page_id", F.md5(doc).alias("document"))


@query(
    "dead_letter_envelopes",
    """select event_id, '{"original_message":{"event_id":' || event_id || ',"user_id":' || user_id || '},"failure_metadata":{"error":"no answer","error_type":"TimeoutError","retry_count":' || (event_id % 6) || ',"failed_at":"2024-05-06T07:08:09+00:00","failure_reason":"max_retries_exceeded"}}' as message,
    case when event_id % 2 = 0 then 'm' || event_id else 'unknown' end as original, cast(event_id % 6 as varchar) as retries from events where event_type = 'error' and event_id % 6 >= 3""",
)
def dead_letter_envelopes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("retry", F.col("event_id") % 6).where(F.col("retry") >= D.MAX_RETRIES)
    message = O.dead_letter(F.struct("event_id", "user_id"), F.lit("no answer"), F.lit("TimeoutError"), F.col("retry"), F.lit("2024-05-06 07:08:09").cast("timestamp"))
    more = O.dead_letter_attributes(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m"), F.col("event_id").cast("string"))), F.col("retry"))
    return e.select("event_id", message.alias("message"), more["OriginalMessageId"].alias("original"), more["RetryCount"].alias("retries"))


#: (id, text, the codec its bytes are written in, content type): what a reader must get back is the text.
CHARSETS = [
    (1, "plain", "utf-8", "text/html"),
    (2, "Straße, déjà vu", "utf-8", "text/html; charset=UTF-8"),
    (3, "Straße, déjà vu", "iso-8859-1", "text/html; charset=ISO-8859-1"),
    (4, "Straße, déjà vu", "iso-8859-1", "text/html"),
    (5, "東京タワー", "shift_jis", "text/html; charset=Shift_JIS"),
    (6, "東京タワー", "euc_jp", "text/html;charset=euc-jp; x=y"),
    (7, "Привет", "windows-1251", "text/html; charset=windows-1251"),
    (8, "déjà", "utf-8", "text/html; charset=no-such-code"),
    (9, "déjà", "iso-8859-1", "text/html; charset=ascii"),
    (10, "", "utf-8", ""),
    (11, "€ sign", "utf-16", "text/html; charset=utf-16"),
]


@query("charset_fixture", "select page_id as id, text || url as text from pages join (values " + ", ".join(f"({i - 1}, '{t}')" for i, t, *_ in CHARSETS) + f") t(k, text) on k = page_id % {len(CHARSETS)}")
def charset_fixture(spark, sf_dir):
    """Each page's URL behind a text in one of the charsets, and the header that names it, names none or a wrong one."""
    which = (F.col("page_id") % len(CHARSETS) + 1).cast("int")
    url = lambda codec: F.encode("url", "UTF-16LE" if codec == "utf-16" else "ISO-8859-1")
    raw, kind = F.lit(None).cast("binary"), F.lit(None).cast("string")
    for i, t, codec, header in CHARSETS:
        raw = F.when(which == i, F.concat(F.lit(bytearray(t.encode(codec))), url(codec))).otherwise(raw)
        kind = F.when(which == i, header).otherwise(kind)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), O.decoded_bytes(raw, kind).alias("text"))


@query("charset_pages", "select page_id, md5(html) as md5 from pages")
def charset_pages(spark, sf_dir):
    """Pages in four encodings by their number, each with the header that names it (or none)."""
    p = table(spark, sf_dir, "pages")
    latin = F.length(F.regexp_replace("html", "[\\x00-\\xff]", "")) == 0
    kind = F.when((F.col("page_id") % 3 == 0) & latin, "iso-8859-1").when(F.col("page_id") % 3 == 1, "utf-16be").otherwise("utf-8")
    raw = F.when(kind == "iso-8859-1", F.encode("html", "ISO-8859-1")).when(kind == "utf-16be", F.encode("html", "UTF-16BE")).otherwise(F.encode("html", "UTF-8"))
    return p.select("page_id", F.md5(O.decoded_bytes(raw, F.concat(F.lit("text/html; charset="), kind))).alias("md5"))


@query("categories_fixture", f"with {SAYING} select d as domain, array_to_string({CATEGORIES}, ',') as categories, count(*) as n from s group by 1, 2")
def categories_fixture(spark, sf_dir):
    """Documents by the domain that is put to them and the categories that follow from it and their words."""
    found = said(spark, sf_dir).select(F.col("d").alias("domain"), F.array_join(T.categories(F.col("t"), F.col("c"), F.col("d")), ",").alias("categories"))
    return found.groupBy("domain", "categories").agg(F.count(F.lit(1)).alias("n"))


ROBOTS = [
    ("a.example", "User-agent: *\nDisallow: /private/\nAllow: /\nCrawl-delay: 3\n\nUser-agent: tarnbot\nUser-agent: other\nDisallow: /bots/ # a remark\nAllow: /\nSitemap: https://a.example/s.xml"),
    ("b.example", "# nothing for anybody\nUSER-AGENT: *\nDISALLOW: /"),
    ("c.example", "User-agent: nobody\nDisallow: /"),
    ("d.example", "User-agent: *\nDisallow:"),
    ("e.example", ""),
]
#: (url, allowed for a bot without rules of its own, for tarnbot, delay for the former).
FETCHES = [
    ("https://a.example/private/x", False, True, 3),
    ("https://a.example/bots/x", True, False, 3),
    ("https://a.example/", True, True, 3),
    ("https://b.example/x?y=1", False, False, None),
    ("https://c.example/x", True, True, None),
    ("https://d.example/x", True, True, None),
    ("https://e.example/x", True, True, None),
    ("https://f.example/x", True, True, None),
]


#: A file for every domain of the pages by the length of its name, without one for some.
FILED = f"d as (select distinct {DOMAIN} as domain from pages), f as (select domain, length(domain) % {len(ROBOTS) + 1} as k from d)"


@query("robots_fixture", f"with {FILED} select 'https://' || domain || path as url, other, mine, delay from f join (values " + ", ".join(f"({'abcdef'.index(u[8])}, '{u[17:]}', {a}, {b}, {'null' if d is None else d})" for u, a, b, d in FETCHES) + ") t(k, path, other, mine, delay) using (k)")
def robots_fixture(spark, sf_dir):
    """The files' cases for all domains of the pages: groups, remarks, upper case, no file at all."""
    d = table(spark, sf_dir, "pages").select(U.domain(F.col("url")).alias("domain")).distinct().withColumn("k", F.length("domain") % (len(ROBOTS) + 1))
    text = F.element_at(F.array(*[F.lit(t) for _, t in ROBOTS], F.lit(None).cast("string")), F.col("k") + 1)
    r = robots.rules(d.select("domain", text.alias("robots")).where("robots is not null"))
    paths = F.element_at(F.array(*[F.array(*[F.lit(u[17:]) for u, *_ in FETCHES if u[8] == c]) for c in "abcdef"]), F.col("k") + 1)
    u = d.select("domain", F.explode(paths).alias("path")).select(F.concat(F.lit("https://"), "domain", "path").alias("url"))
    other = robots.can_fetch(u, r, "somebot").select("url", F.col("allowed").alias("other"), F.col("crawl_delay").alias("delay"))
    return other.join(robots.can_fetch(u, r, "tarnbot/1.0").select("url", F.col("allowed").alias("mine")), "url").select("url", "other", "mine", "delay")


@query("known_urls_semi", "select page_id from pages where page_id % 2 = 1")
def known_urls_semi(spark, sf_dir):
    """Of found links those whose normal form is known: odd ones differ by a fragment only, even ones lead elsewhere."""
    p = table(spark, sf_dir, "pages")
    known = p.select(U.url_hash(F.col("url")).alias("h")).distinct()
    link = F.when(F.col("page_id") % 2 == 1, F.concat("url", F.lit("#top"))).otherwise(F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/not/there/"), F.col("page_id").cast("string")))
    return p.select("page_id", U.url_hash(U.normalize(link)).alias("h")).join(known, "h", "left_semi").select("page_id")


@query("migration_order", "select cast(page_id as bigint) as version, cast(row_number() over (order by page_id) as bigint) as up, cast(row_number() over (order by page_id desc) as bigint) as down from pages order by page_id limit 20")
def migration_order(spark, sf_dir):
    """Steps up in the order of their versions, oldest first; back in the reverse order."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("version"))
    many = p.count()
    # a window over twenty rows
    first = stores.migration_plan(p, "version").limit(20)
    return first.select("version", F.row_number().over(Window.orderBy("version")).cast("long").alias("up")).withColumn("down", F.lit(many) - F.col("up") + 1)


@query(
    "result_records",
    f"""select page_id, 'raw' as kind, length(html) > 1000 as cut, least(length(html), 1000) as told, {DOMAIN} as domain, cast(null as varchar) as language from pages
    union all select page_id, 'parsed', length(html) > 200, least(length(html), 200), {DOMAIN}, case when page_id % 5 = 0 then 'unknown' else 'en' end from pages""",
)
def result_records(spark, sf_dir):
    """Both objects of a crawl result with their metadata: the page as a long error and as a long title, cut to their limits."""
    p = table(spark, sf_dir, "pages")
    at, domain, lang = F.lit("2024-02-03 04:05:06").cast("timestamp"), U.domain(F.col("url")), F.when(F.col("page_id") % 5 > 0, "en")
    raw = O.raw_metadata(F.col("url"), domain, F.lit(200), at, F.col("html"))
    parsed = O.parsed_metadata(F.col("url"), domain, lang, F.col("html"), F.lit(None).cast("timestamp"))
    said_of = lambda kind, m, c: F.struct(F.lit(kind).alias("kind"), (F.length("html") > F.length(m[c])).alias("cut"), F.length(m[c]).alias("told"), m["domain"].alias("domain"), m["language"].alias("language"))
    return p.select("page_id", F.explode(F.array(said_of("raw", raw, "crawl-error"), said_of("parsed", parsed, "title"))).alias("r")).select("page_id", "r.*")


@query(
    "processing_events",
    f"select page_id, '{{\"event_type\":\"' || k || '\",\"url\":\"' || url || '\",\"timestamp\":\"2024-02-03T04:05:06+00:00\",\"details\":{{\"bytes\":' || octet_length(encode(html)) || '}}}}' as body, k as kind, {DOMAIN} as domain from pages, (values ('content_stored'), ('processing_complete')) v(k)",
)
def processing_events(spark, sf_dir):
    """Two messages for each page, with their attributes."""
    p = table(spark, sf_dir, "pages").withColumn("kind", F.explode(F.array(F.lit("content_stored"), F.lit("processing_complete"))))
    m = O.processing_event(F.col("kind"), F.col("url"), U.domain(F.col("url")), F.lit("2024-02-03 04:05:06").cast("timestamp"), F.struct(F.octet_length("html").alias("bytes")))
    return p.select("page_id", m.alias("m")).select("page_id", "m.body", F.col("m.attributes")["EventType"].alias("kind"), F.col("m.attributes")["Domain"].alias("domain"))
