"""URL functions, filters, frontier selection and deduplication over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import urls as U
from tarn.plans.registry import query, table

#: SQL pieces shared by the oracles.
NETLOC = "lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
DOMAIN = f"split_part({NETLOC}, ':', 1)"
PATH = "regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1)"
SCHEME = "lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
NORMAL = f"""{SCHEME} || '://' ||
 (case when {SCHEME} = 'http' then regexp_replace({NETLOC}, ':80$', '') else regexp_replace({NETLOC}, ':443$', '') end) ||
 (case when {PATH} in ('', '/') then '/' else regexp_replace({PATH}, '/+$', '') end) ||
 (case when {QUERY} = '' then '' else '?' || array_to_string(list_transform(list_sort(list_transform(list_filter(string_split({QUERY}, '&'), lambda x: x <> ''),
   lambda x: {{'k': split_part(x, '=', 1), 'v': case when contains(x, '=') then list_extract(string_split(x, '='), -1) else '' end}})), lambda x: x.k || '=' || x.v), '&') end)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query("url_normalize", f"select page_id, {NORMAL} as normalized from pages")
def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query("url_normalize_exact", f"select page_id, {NORMAL} as normalized from pages")
def url_normalize_exact(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalize_exact("url").alias("normalized"))


#: Page URLs with parameters that hold equals signs, blanks, escapes, repeated names and empty parts.
ASKED = "url || '?z=' || page_id || '=x==&q=a b&q=a+a&%C3%A9=%2A~*&b&&a=%3D%26' || (page_id % 7) || '&b=ü' as url"
DECODED = "url_decode(replace({}, '+', ' '))"
RECODED = "replace(url_encode({}), '%20', '+')"
PARAMETERS = f"""select page_id, split_part(url, '?', 1) || '?' || array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(split_part(url, '?', 2), '&'), lambda x: x <> ''),
   lambda x: {{'k': {DECODED.format("split_part(x, '=', 1)")}, 'v': {DECODED.format("substr(x, length(split_part(x, '=', 1)) + 2)")}}})), lambda x: {RECODED.format("x.k")} || '=' || {RECODED.format("x.v")}), '&') as normalized
   from (select page_id, {ASKED} from (select page_id, split_part({NORMAL}, '?', 1) as url from pages))"""


def asked_urls(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", F.substring_index(U.normalize(F.col("url")), "?", 1).alias("url"))
    more = F.format_string("?z=%d=x==&q=a b&q=a+a&%%C3%%A9=%%2A~*&b&&a=%%3D%%26%d&b=ü", "page_id", F.col("page_id") % 7)
    return p.select("page_id", F.concat("url", more).alias("url"))


@query("url_normalize_parameters", PARAMETERS)
def url_normalize_parameters(spark, sf_dir):
    return asked_urls(spark, sf_dir).select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query("url_hash_parameters", f"select page_id, sha256(normalized) as url_hash from ({PARAMETERS})")
def url_hash_parameters(spark, sf_dir):
    return asked_urls(spark, sf_dir).select("page_id", U.url_hash(F.col("url")).alias("url_hash"))


@query("url_hash", f"select page_id, sha256({NORMAL}) as url_hash from pages")
def url_hash(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.url_hash(F.col("url")).alias("url_hash"))


@query(
    "url_parts",
    f"""select page_id, {DOMAIN} as domain, try_cast(nullif(regexp_extract({NETLOC}, ':([0-9]+)$', 1), '') as int) as port,
    cast(case when trim({PATH}, '/') = '' then 0 else len(string_split(trim({PATH}, '/'), '/')) end as int) as depth,
    ({SCHEME} in ('http', 'https') and {NETLOC} <> '') as valid, contains(lower(url), 'sitemap') as is_sitemap,
    regexp_matches({DOMAIN}, '^[0-9.]+$') as is_address from pages""",
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.domain(u).alias("domain"), U.port(u).alias("port"), U.depth(u).cast("int").alias("depth"), U.is_valid(u).alias("valid"), U.is_sitemap(u).alias("is_sitemap"), U.is_address(U.domain(u)).alias("is_address"))


@query("url_include_filter", f"select page_id, url from pages where length(url) between 1 and 2048 and regexp_matches(lower(url), '^https?://') and not regexp_matches(lower(url), '\\.({'|'.join(U.FRONTIER_EXTENSIONS)})$')")
def url_include_filter(spark, sf_dir):
    return pages(spark, sf_dir).where(U.included(F.col("url"))).select("page_id", "url")


@query(
    "url_crawlable",
    f"""select page_id, case when not contains(list_extract(string_split(lower({PATH}), '/'), -1), '.') then true
    else list_extract(string_split(lower({PATH}), '.'), -1) not in ({', '.join(f"'{x}'" for x in U.NOT_CRAWLABLE)}) end as crawlable from pages""",
)
def url_crawlable(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.crawlable(F.col("url")).alias("crawlable"))


@query("url_same_domain", f"with d as (select page_id, {DOMAIN} as domain from pages) select a.page_id, a.domain = b.domain as same from d a join d b on b.page_id = a.page_id + 1")
def url_same_domain(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return p.join(nxt, "page_id").select("page_id", U.same_domain(F.col("url"), F.col("other")).alias("same"))


@query("url_document_id", "select page_id, substr(sha256(url), 1, 16) as document_id from pages")
def url_document_id(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.document_id(F.col("url")).alias("document_id"))


@query("url_resolve", f"select page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/about' as resolved from pages")
def url_resolve(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.resolve("url", F.lit("/about")).alias("resolved"))


@query(
    "sitemap_candidates",
    f"""select distinct 'https://' || {DOMAIN} || p as candidate from pages, (select unnest([{', '.join(f"'{p}'" for p in U.SITEMAP_PATHS + U.PROBED_SITEMAP_PATHS[4:])}]) as p)""",
)
def sitemap_candidates(spark, sf_dir):
    """Union of both path lists for each domain (domains first, so that few rows explode)."""
    hosts = pages(spark, sf_dir).select(U.domain(F.col("url")).alias("host")).distinct()
    a = hosts.select(F.explode(U.sitemap_candidates(F.col("host"))).alias("candidate"))
    b = hosts.select(F.explode(U.sitemap_candidates(F.col("host"), paths=U.PROBED_SITEMAP_PATHS)).alias("candidate"))
    return a.union(b).distinct()


@query("object_key", f"""select page_id, 'raw-html/2024/01/' || lpad(cast(1 + page_id % 28 as varchar), 2, '0') || '/' || {DOMAIN} || '/' || sha256({NORMAL}) || '.html.gz' as object_key from pages""")
def object_key(spark, sf_dir):
    at = F.expr("date_add(date'2024-01-01', cast(page_id % 28 as int))")
    return pages(spark, sf_dir).select("page_id", U.object_key("raw", F.col("url"), at).alias("object_key"))


# ---- frontier ---------------------------------------------------------------------------------------


def sitemap_entries(spark, sf_dir) -> DataFrame:
    """What a sitemap tells of each page: priority (some 0, some missing) and last change (some missing)."""
    return pages(spark, sf_dir).select(
        "page_id",
        "url",
        U.domain(F.col("url")).alias("domain"),
        F.expr("case when page_id % 4 = 3 then null else (page_id % 11) / 10.0d end").alias("priority"),
        F.expr("case when page_id % 5 = 4 then null else date_add(date'2024-01-01', cast(page_id % 60 as int)) end").alias("last_modified"),
    )


ENTRIES = f"""e as (select page_id, url, {DOMAIN} as domain, case when page_id % 4 = 3 then null else cast(page_id % 11 as double) / 10.0 end as priority,
 case when page_id % 5 = 4 then null else date '2024-01-01' + cast(page_id % 60 as int) end as last_modified from pages)"""


def order() -> list:
    """Priority (0 and missing count as 0.5), then the newest, then the shortest URL."""
    return [F.coalesce(F.expr("nullif(priority, 0d)"), F.lit(0.5)).desc(), F.col("last_modified").desc_nulls_last(), F.length("url"), F.col("page_id")]



SQL_ORDER = "coalesce(nullif(priority, 0), 0.5) desc, last_modified desc nulls last, length(url), page_id"


@query("frontier_topn", f"with {ENTRIES} select page_id, url from e order by {SQL_ORDER} limit 50")
def frontier_topn(spark, sf_dir):
    """The 50 best URLs: a partial top-n on every task."""
    return sitemap_entries(spark, sf_dir).orderBy(*order()).limit(50).select("page_id", "url")


@query("frontier_topn_by_domain", f"with {ENTRIES}, r as (select *, row_number() over (partition by domain order by {SQL_ORDER}) as rank from e) select page_id, domain, rank from r where rank <= 3")
def frontier_topn_by_domain(spark, sf_dir):
    w = Window.partitionBy("domain").orderBy(*order())
    return sitemap_entries(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("page_id", "domain", "rank")


@query("in_batch_dedup", f"with n as (select page_id, lower({NORMAL}) as norm from pages) select norm, min(page_id) as page_id from n group by norm")
def in_batch_dedup(spark, sf_dir):
    """First occurrence of each normalised URL; the minimum combines map-side."""
    return pages(spark, sf_dir).groupBy(F.lower(U.normalize(F.col("url"))).alias("norm")).agg(F.min("page_id").alias("page_id"))


@query("frontier_anti_join", f"with n as (select page_id, sha256({NORMAL}) as h from pages) select page_id from n where h not in (select h from n where page_id % 3 = 0)")
def frontier_anti_join(spark, sf_dir):
    n = pages(spark, sf_dir).select("page_id", U.url_hash(F.col("url")).alias("h"))
    return n.join(n.where("page_id % 3 = 0").select("h"), "h", "left_anti").select("page_id")


@query("is_duplicate_semi", "select page_id, 'respelled' as how from pages")
def is_duplicate_semi(spark, sf_dir):
    """Every page asked for again, in another spelling and one level deeper: the first is known, the second is not."""
    p = pages(spark, sf_dir)
    known = p.select(U.url_hash(F.col("url")).alias("h"))
    u = F.col("url")
    host, path, params = F.concat(U.scheme(u), F.lit("://"), U.netloc(u)), F.regexp_replace(U.path(u), "/+$", ""), U.query_string(u)
    respelled = F.concat(F.upper(host), path, F.lit("/"), F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""), F.lit("#again"))
    ways = {"respelled": respelled, "deeper": F.concat(host, path, F.lit("/more"))}
    asked = p.select("page_id", F.explode(F.array(*[F.struct(F.lit(how).alias("how"), way.alias("url")) for how, way in ways.items()])).alias("a"))
    return asked.select("page_id", "a.how", U.url_hash(F.col("a.url")).alias("h")).join(known, "h", "left_semi").select("page_id", "how")


@query(
    "dedup_stats",
    f"""with n as (select url, {NORMAL} as norm from pages) select count(*) as processed, count(distinct lower(norm)) as unique_urls, count(*) - count(distinct lower(norm)) as duplicates,
    cast(sum(case when norm <> url then 1 else 0 end) as bigint) as normalization_changes, round((count(*) - count(distinct lower(norm))) / count(*), 6) as duplicate_rate from n""",
)
def dedup_stats(spark, sf_dir):
    n = pages(spark, sf_dir).select("url", U.normalize(F.col("url")).alias("norm"))
    return n.agg(
        F.count(F.lit(1)).alias("processed"),
        F.countDistinct(F.lower("norm")).alias("unique_urls"),
        (F.count(F.lit(1)) - F.countDistinct(F.lower("norm"))).alias("duplicates"),
        F.count_if(F.col("norm") != F.col("url")).alias("normalization_changes"),
        F.round((F.count(F.lit(1)) - F.countDistinct(F.lower("norm"))) / F.count(F.lit(1)), 6).alias("duplicate_rate"),
    )


@query("dedup_stats_by_domain", f"select {DOMAIN} as domain, count(*) as total, count(distinct {NORMAL}) as unique_urls, round(1 - count(distinct {NORMAL}) / count(*), 6) as duplicate_rate from pages group by 1")
def dedup_stats_by_domain(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).groupBy(U.domain(u).alias("domain")).agg(F.count(F.lit(1)).alias("total"), F.countDistinct(U.normalize(u)).alias("unique_urls"), F.round(1 - F.countDistinct(U.normalize(u)) / F.count(F.lit(1)), 6).alias("duplicate_rate"))
