"""Robots rules and sitemaps as tables."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions import urls as U
from tarn.operators.graph import cut_lineage


def rules(files: DataFrame, domain: str = "domain", body: str = "robots") -> DataFrame:
    """(domain, agent, idx, allow, path, crawl_delay): one row per rule line and per delay, in order.

    Lines are cut and numbered by built-in functions; a group is the run of
    agent lines before its rules.  An empty disallow allows everything.
    """
    lines = files.select(F.col(domain).alias("domain"), F.posexplode(F.split(F.col(body), r"\r?\n")).alias("idx", "line"))
    pair = lines.select("domain", "idx", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), "#.*$", "")).alias("v")).where("k in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    w = Window.partitionBy("domain").orderBy("idx")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    grouped = pair.withColumn("group", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where("k = 'user-agent'").select("domain", "group", F.lower("v").alias("agent"))
    body_rows = grouped.where("k <> 'user-agent'")
    return body_rows.join(agents, ["domain", "group"]).select(
        "domain",
        "agent",
        "idx",
        F.when(F.col("k") == "allow", True).when(F.col("k") == "disallow", F.col("v") == "").alias("allow"),
        F.when(F.col("k").isin("allow", "disallow"), F.col("v")).alias("path"),
        F.when(F.col("k") == "crawl-delay", F.col("v").try_cast("int")).alias("crawl_delay"),
    )


def can_fetch(urls: DataFrame, rules_: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed`` and ``crawl_delay``: the first matching rule of the agent's group, else of ``*``, else allowed."""
    mine = rules_.where(F.lit(agent.lower()).contains(F.col("agent")) & (F.col("agent") != "*")).withColumn("rank", F.lit(0))
    any_ = rules_.where("agent = '*'").withColumn("rank", F.lit(1))
    every = mine.unionByName(any_)
    best = every.groupBy("domain").agg(F.min("rank").alias("rank"))
    chosen = every.join(best, ["domain", "rank"]).groupBy("domain").agg(
        F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("idx", "allow", "path")))).alias("rules"), F.max("crawl_delay").alias("crawl_delay")
    )
    rest = F.concat(U.path(F.col(url)), F.when(U.query_string(F.col(url)) != "", F.concat(F.lit("?"), U.query_string(F.col(url)))).otherwise(""))
    rest = F.when(rest == "", "/").otherwise(rest)
    with_rules = urls.withColumn("domain", U.domain(F.col(url))).join(chosen, "domain", "left")
    hit = F.try_element_at(F.filter("rules", lambda r: rest.startswith(r["path"])), F.lit(1))
    return with_rules.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("rules")


def sitemap_lines(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?im)^sitemap:\s*(\S+)"))


def rule_counts(rules_: DataFrame, mode: str = "faithful") -> DataFrame:
    """Allow and disallow counts by domain; as written the default group is not counted."""
    rows = rules_ if mode == "intended" else rules_.where("agent <> '*'")
    return rows.groupBy("domain").agg(F.count_if(F.col("allow")).alias("allows"), F.count_if(~F.col("allow")).alias("disallows"))


def sitemap_kind(xml: Column) -> Column:
    return F.when(xml.rlike(r"<(\w+:)?urlset[\s>]"), "urlset").when(xml.rlike(r"<(\w+:)?sitemapindex[\s>]"), "sitemapindex")


def sitemap_urls(files: DataFrame, source: str = "sitemap", xml: str = "xml") -> DataFrame:
    """(source, kind, url, last_modified, change_frequency, priority): the entries of sitemaps and indexes, namespaced or not."""
    entry = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)>(.*?)</(?:\w+:)?(?:url|sitemap)>"))

    def field(name):
        return F.trim(F.regexp_extract("entry", rf"(?s)<(?:\w+:)?{name}>(.*?)</(?:\w+:)?{name}>", 1))

    rows = files.select(F.col(source).alias("source"), sitemap_kind(F.col(xml)).alias("kind"), F.explode(entry).alias("entry"))
    loc = F.replace(field("loc"), F.lit("&amp;"), F.lit("&"))
    return rows.select(
        "source",
        "kind",
        U.normalize(loc).alias("url"),
        T.last_modified(T.blank_to_null(field("lastmod"))).alias("last_modified"),
        T.blank_to_null(field("changefreq")).alias("change_frequency"),
        T.sitemap_priority(T.blank_to_null(field("priority"))).alias("priority"),
    ).where("url is not null")


def crawl_sitemaps(start: DataFrame, store: DataFrame, depth: int = 3) -> DataFrame:
    """All page URLs reachable from the start sitemaps: level by level, each sitemap once, ``depth`` levels at most.

    ``store`` (sitemap, xml) stands for fetching; each level is a join with it.
    """
    level = start.select(F.col("sitemap")).distinct()
    seen = level
    found = None
    for _ in range(depth + 1):
        entries = cut_lineage(sitemap_urls(store.join(level, "sitemap")))
        nested = U.is_sitemap(F.col("url"))
        leaves = entries.where(~nested)
        found = leaves if found is None else found.union(leaves)
        level = cut_lineage(entries.where(nested).select(F.col("url").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti"))
        seen = seen.union(level)
        if not level.limit(1).count():
            break
    return found


def allows(path: str, prefix: str) -> bool:
    """The match of one rule, for tests."""
    return unquote(path).startswith(unquote(prefix))
