"""Document processing, gates and priorities over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import decisions as D
from tarn.functions import text as T
from tarn.functions import urls as U
from tarn.operators import language as L
from tarn.plans.registry import query, table
from tarn.plans.url_queries import DOMAIN


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def sql_replace(expr: str) -> str:
    for entity, plain in T.ENTITIES:
        q = plain.replace("'", "''")
        expr = f"replace({expr}, '{entity}', '{q}')"
    return expr


@query("text_preprocess", f"select doc_id, md5(trim({sql_replace('text')})) as md5 from documents")
def text_preprocess(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.preprocess(F.col("text"))).alias("md5"))


@query("text_preprocess_intended", f"""select doc_id, md5(trim({sql_replace("regexp_replace(text, '\\s+', ' ', 'g')")})) as md5 from documents""")
def text_preprocess_intended(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.preprocess(F.col("text"), "intended")).alias("md5"))


@query("title_coalesce", "select doc_id, case when trim(title) <> '' then substr(trim(title), 1, 200) else 'Untitled Document' end as title from (select doc_id, case when doc_id % 3 = 0 then split_part(text, chr(10), 1) else '' end as title from documents)")
def title_coalesce(spark, sf_dir):
    first = F.when(F.col("doc_id") % 3 == 0, F.split_part("text", F.lit("\n"), F.lit(1)))
    return docs(spark, sf_dir).select("doc_id", T.title([first], F.lit("http://h.com/")).alias("title"))


@query("body_coalesce", "select doc_id, md5(case when doc_id % 4 = 0 then text when doc_id % 4 = 1 then lang || ' ' || source else 'No content available' end) as md5 from documents")
def body_coalesce(spark, sf_dir):
    k = F.col("doc_id") % 4
    b = T.body([F.when(k == 0, F.col("text"))], [F.when(k == 1, F.col("lang")), F.when(k == 1, F.col("source"))])
    return docs(spark, sf_dir).select("doc_id", F.md5(b).alias("md5"))


#: What is put to each document by its number: (title, words after the text, domain), some of which say a category.
SAID = [
    ("Docker and Kubernetes", "how we run our database", "blog.example"),
    ("Quarterly report", "sales and marketing strategy", "nikkei.com"),
    ("Hello", "nothing at all", "github.com"),
    ("Breaking update", "", "news.yahoo.co.jp"),
    ("An essay", "about walking", "medium.com"),
    ("An essay", "about walking", "example.com"),
    ("React for finance", "PYTHON api", "zenn.dev"),
]
CATEGORIES = f"""list_sort(list_distinct(list_concat(case d {" ".join(f"when '{h}' then [{', '.join(repr(x) for x in names)}]" for h, names in T.DOMAIN_CATEGORIES.items())} else [] end,
 list_filter([{', '.join(f"case when regexp_matches(lower(t || ' ' || c), '{'|'.join(w)}') then '{n}' end" for n, w in T.CATEGORY_WORDS.items())}], lambda x: x is not null))))"""
SAYING = f"""s as (select doc_id, t, text || ' ' || w as c, d from documents join (values {", ".join(f"({k}, '{t}', '{w}', '{d}')" for k, (t, w, d) in enumerate(SAID))}) v(k, t, w, d) on k = doc_id % {len(SAID)})"""


def said(spark, sf_dir):
    """(doc_id, t, c, d): title, content and domain of each document."""
    of = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(d).alias("d")) for t, w, d in SAID]), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", "text", of.alias("o")).select("doc_id", "o.t", F.concat("text", F.lit(" "), "o.w").alias("c"), "o.d")


@query("doc_categories", f"with {SAYING} select doc_id, array_to_string({CATEGORIES}, ',') as categories from s")
def doc_categories(spark, sf_dir):
    return said(spark, sf_dir).select("doc_id", F.array_join(T.categories(F.col("t"), F.col("c"), F.col("d")), ",").alias("categories"))


WORDS = "list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{3,}'))"
FROM_TITLE = "list_filter(list_transform(string_split_regex(substr(text, 1, 80), '[|\\-—–:：｜]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 2)"


@query("doc_keywords", f"select doc_id, array_to_string(list_sort(list_filter(list_distinct(list_concat({FROM_TITLE}, list_transform(({WORDS})[1:15], lambda x: lower(x)))), lambda x: length(x) between 2 and 50))[1:20], chr(1)) as keywords from documents")
def doc_keywords(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.keywords(F.substring("text", 1, 80), F.col("text"), mode="intended"), "\x01").alias("keywords"))



@query("category_counts", f"with {SAYING}, x as (select doc_id, unnest({CATEGORIES}) as category from s) select category, count(*) as n from x group by 1")
def category_counts(spark, sf_dir):
    return said(spark, sf_dir).select(F.explode(T.categories(F.col("t"), F.col("c"), F.col("d"))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("content_hash", "select doc_id, md5(text) as content_md5 from documents")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5("text").alias("content_md5"))


@query("snippet_projection", "select doc_id, md5(case when length(text) > 300 then substr(text, 1, 300) || '...' else text end) as snippet_md5 from documents")
def snippet_projection(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.snippet(F.col("text"))).alias("snippet_md5"))


@query("token_estimate", "select doc_id, cast(floor(length(text) / 4) as bigint) as tokens from documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("optimal_chunk_size", "select doc_id, least(cast(floor(length(text) / 4) as bigint), 8000) as size from documents")
def optimal_chunk_size(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.optimal_chunk(F.length("text").cast("long"), 4, 8000).alias("size"))


@query(
    "embed_truncate",
    """with c as (select doc_id, text, substr(text, 1, 8192) as cut from documents), s as (select *, 8192 - instr(reverse(cut), ' ') as space, instr(reverse(cut), ' ') as back from c)
    select doc_id, cast(length(case when length(text) <= 8192 then text when back > 0 and space > 8192 * 0.8 then substr(cut, 1, space) else cut end) as bigint) as n from s""",
)
def embed_truncate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length(T.truncated(F.col("text"))).cast("long").alias("n"))


@query(
    "word_count_reading_time",
    """with w as (select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as bigint) as words from documents) select doc_id, words, greatest(1, words // 200) as minutes from w""",
)
def word_count_reading_time(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"))
    return d.select("doc_id", "words", T.reading_minutes(F.col("words")).alias("minutes"))


#: The first characters of a document with up to nine kanji behind them.
MIXED = "select doc_id, substr(text, 1, 20) || repeat('東', cast(doc_id % 10 as int)) as t from documents"
JA_SHARE = "length(regexp_replace(t, '[^\u3040-\u309f\u30a0-\u30ff\u4e00-\u9faf]', '', 'g')) / length(t)"


def mixed(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.concat(F.substring("text", 1, 20), F.repeat(F.lit("東"), (F.col("doc_id") % 10).cast("int"))).alias("t"))


@query("is_japanese", f"with m as ({MIXED}) select doc_id, {JA_SHARE} > 0.1 as japanese from m")
def is_japanese(spark, sf_dir):
    return mixed(spark, sf_dir).select("doc_id", T.is_japanese(F.col("t")).alias("japanese"))


@query("is_japanese_fixture", f"with m as ({MIXED}) select doc_id as id, {JA_SHARE} > 0.1 as tenth, {JA_SHARE} > 0 as any_at_all, {JA_SHARE} > 0.3 as three_tenths from m")
def is_japanese_fixture(spark, sf_dir):
    """The share of kana and kanji against the limits that the variants use."""
    t = F.col("t")
    return mixed(spark, sf_dir).select(F.col("doc_id").alias("id"), T.is_japanese(t).alias("tenth"), T.is_japanese(t, 0.0).alias("any_at_all"), T.is_japanese(t, 0.3).alias("three_tenths"))


@query("japanese_normal_forms", "select doc_id as id, 'ABC' || doc_id || upper(lang) || 'xyz東京' as normal from documents")
def japanese_normal_forms(spark, sf_dir):
    """Each document's number and language in wide characters, with marks between them."""
    wide = lambda c: F.translate(c, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    told = F.concat(F.lit("ＡＢＣ"), wide(F.col("doc_id").cast("string")), wide(F.upper("lang")), F.lit("※ｘｙｚ★東京"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), T.japanese_normal(told).alias("normal"))


def language(spark, sf_dir, mode):
    found = docs(spark, sf_dir).select("doc_id", L.detected(F.col("text")).alias("found"))
    return found.select("doc_id", "found.code", F.round("found.prob", 6).alias("prob"), L.language_code(F.col("found"), mode).alias("lang"))


@query("language_detect")
def language_detect(spark, sf_dir):
    return language(spark, sf_dir, "faithful")


@query("language_detect_intended")
def language_detect_intended(spark, sf_dir):
    return language(spark, sf_dir, "intended")


CRAWL = f"""c as (select page_id, url, {DOMAIN} as domain, case when page_id % 7 = 0 then 404 when page_id % 11 = 0 then 500 else 200 end as status,
 case when page_id % 13 = 0 then 'late' end as error, case when page_id % 5 = 0 then null when page_id % 9 = 0 then url else html end as body,
 page_id % 40 as age, substr(url, 8, cast(page_id % 30 as int)) as title, case when page_id % 2 = 0 then 'd' end as description, list_extract(['ja', 'en', 'fr'], cast(1 + page_id % 3 as int)) as lang from pages)"""


def crawl(spark, sf_dir):
    """A crawl result for each page, made from its number."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        U.domain(F.col("url")).alias("domain"),
        F.expr("case when page_id % 7 = 0 then 404 when page_id % 11 = 0 then 500 else 200 end").alias("status"),
        F.expr("case when page_id % 13 = 0 then 'late' end").alias("error"),
        F.expr("case when page_id % 5 = 0 then null when page_id % 9 = 0 then url else html end").alias("body"),
        (F.col("page_id") % 40).alias("age"),
        F.expr("substr(url, 8, cast(page_id % 30 as int))").alias("title"),
        F.expr("case when page_id % 2 = 0 then 'd' end").alias("description"),
        F.expr("element_at(array('ja', 'en', 'fr'), cast(1 + page_id % 3 as int))").alias("lang"),
    )


@query("index_gate", f"with {CRAWL} select page_id, (status = 200 and coalesce(error, '') = '' and (body is null or length(trim(body)) >= 100)) as index_it from c")
def index_gate(spark, sf_dir):
    return crawl(spark, sf_dir).select("page_id", D.should_index(F.col("status"), F.col("error"), F.col("body").isNotNull(), F.col("body")).alias("index_it"))


PRIORITY = "(case when domain = 'example.com' then 10 else 0 end + case when age < 1 then 5 when age < 7 then 3 when age < 30 then 1 else 0 end + case when length(title) > 10 then 2 else 0 end + case when length(description) > 0 then 1 else 0 end + case when lang in ('ja', 'en') then 1 else 0 end)"


@query("index_priority", f"with {CRAWL} select page_id, {PRIORITY} as priority from c")
def index_priority(spark, sf_dir):
    return crawl(spark, sf_dir).select("page_id", D.index_priority(F.col("domain"), F.col("age"), F.col("title"), F.col("description"), F.col("lang")).alias("priority"))


@query("index_envelope", f"""with {CRAWL} select page_id, '{{"url":"' || url || '","domain":"' || domain || '","status_code":' || status || ',"processing_priority":' || {PRIORITY} || '}}' as message from c""")
def index_envelope(spark, sf_dir):
    c = crawl(spark, sf_dir)
    p = D.index_priority(F.col("domain"), F.col("age"), F.col("title"), F.col("description"), F.col("lang"))
    return c.select("page_id", F.to_json(F.struct("url", "domain", F.col("status").alias("status_code"), p.alias("processing_priority"))).alias("message"))


@query("domain_priority_join", f"with {CRAWL} select domain, cast(sum(case when domain = 'example.com' then 10 else 0 end) as bigint) as points from c group by domain")
def domain_priority_join(spark, sf_dir):
    bonus = F.lit(0)
    for host, points in D.DOMAIN_PRIORITY.items():
        bonus = F.when(F.col("domain") == host, points).otherwise(bonus)
    return crawl(spark, sf_dir).groupBy("domain").agg(F.sum(bonus).alias("points"))


@query("response_validation", f"with {CRAWL} select case when status = 404 then 'not_found' when status >= 500 then 'server_error' when status >= 400 then 'client_error' else 'ok' end as verdict, count(*) as n from c group by 1")
def response_validation(spark, sf_dir):
    return crawl(spark, sf_dir).groupBy(D.response_verdict(F.col("status")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("size_limited_pages", "select page_id from pages where octet_length(encode(html)) <= 4000")
def size_limited_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.octet_length("html") <= 4000).select("page_id")


@query("error_classify", f"""with {CRAWL}, k as (select page_id, status, case when page_id % 17 = 0 then 'robots' when page_id % 19 = 0 then 'timeout' when error is not null then 'parse' end as kind from c)
 select page_id, case when kind = 'robots' then 'robots_blocked' when kind = 'timeout' then 'timeout' when kind = 'parse' then 'parse_error' when status >= 400 then 'http_error' else 'unknown' end as error_type,
 case when kind = 'robots' or kind = 'parse' then false when kind = 'timeout' then page_id % 5 < 3 when status = 404 then false when status >= 500 then page_id % 5 < 3 else page_id % 5 < 2 end as retry from k""")
def error_classify(spark, sf_dir):
    kind = F.when(F.col("page_id") % 17 == 0, "robots").when(F.col("page_id") % 19 == 0, "timeout").when(F.col("error").isNotNull(), "parse")
    e = crawl(spark, sf_dir).select("page_id", D.classify(kind, F.col("status")).alias("e"))
    return e.select("page_id", "e.error_type", D.should_retry(F.col("e"), F.col("page_id") % 5).alias("retry"))


@query("backoff_schedule", "select event_id, r as retry, least(3600, cast(60 * pow(2, r) as bigint)) as delay, least(300, cast(pow(2, r) as bigint)) as dlq_delay, round(least(30.0, 2.0 * pow(2.0, r)), 6) as network_delay from (select event_id, event_id % 12 as r from events)")
def backoff_schedule(spark, sf_dir):
    """Delays by the number of tries, which an event's number gives."""
    r = F.col("retry")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12).alias("retry"))
    return e.select("event_id", "retry", D.backoff(r).alias("delay"), D.dlq_delay(r).alias("dlq_delay"), F.round(D.preset_delay(r, "network"), 6).alias("network_delay"))


@query("retry_schedule", f"with {CRAWL} select page_id, cast(unnest(range(0, 3)) as bigint) as attempt from c where status >= 500")
def retry_schedule(spark, sf_dir):
    return crawl(spark, sf_dir).where("status >= 500").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(D.MAX_RETRIES - 1).cast("long"))).alias("attempt"))


@query("generic_filter", "select doc_id from documents where lang in ('en', 'fr') and n_chars >= 500 and source in ('src0', 'src1', 'src3')")
def generic_filter(spark, sf_dir):
    from tarn.operators.search import build_filter

    return docs(spark, sf_dir).where(build_filter({"lang": ["en", "fr"], "source": ["src0", "src1", "src3"], "n_chars": {"gte": 500}})).select("doc_id")


@query("index_document_projection", "select doc_id, '{\"title\":\"' || lang || '\",\"n\":' || n_chars || '}' as document from documents")
def index_document_projection(spark, sf_dir):
    """A small projection (``index_document`` has all fields).  Falsy optional fields are left out of the index document."""
    empty = F.nullif(F.lit(""), F.lit(""))
    return docs(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("lang").alias("title"), empty.alias("description"), F.col("n_chars").alias("n")), {"ignoreNullFields": "true"}).alias("document"))
