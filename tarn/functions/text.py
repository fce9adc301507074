"""Text clean-up, titles, keywords, categories, dates and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in the order of their replacement, category words and domains, date formats.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "..."))
CATEGORY_WORDS = {
    "technology": ("python", "javascript", "react", "aws", "docker", "kubernetes", "api", "database"),
    "business": ("business", "marketing", "sales", "finance", "management", "strategy"),
    "news": ("news", "breaking", "update", "report", "announcement"),
}
DOMAIN_CATEGORIES = {
    "github.com": ("technology", "software"),
    "stackoverflow.com": ("technology", "programming"),
    "qiita.com": ("technology", "programming", "japanese"),
    "zenn.dev": ("technology", "programming", "japanese"),
    "note.com": ("blog", "japanese"),
    "medium.com": ("blog", "article"),
    "wikipedia.org": ("reference", "encyclopedia"),
    "news.yahoo.co.jp": ("news", "japanese"),
    "nikkei.com": ("news", "business", "japanese"),
}
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
SYMBOLS = "[・※◆★☆■□◎●○△▲▼▽]"
FULL_WIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
HALF_WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KANA_KANJI = "[぀-ゟ゠-ヿ一-龯]"
FIRST_WORDS, MOST_KEYWORDS = 15, 20


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def title(candidates: list[Column], url: Column) -> Column:
    """First non-blank candidate, trimmed and cut to 200; else the last URL segment in words; else a fixed title."""
    segment = F.element_at(F.split(url, "/"), -1)
    words = F.initcap(F.translate(segment, "-_", "  "))
    from_url = F.when((segment != "") & ~segment.rlike(r"\.(html|php|asp)$"), words)
    return F.coalesce(F.substring(F.trim(F.coalesce(*[blank_to_null(c) for c in candidates])), 1, 200), from_url, F.lit("Untitled Document"))


def body(candidates: list[Column], fallbacks: list[Column]) -> Column:
    """First non-blank body, else the descriptions joined by a space, else a fixed text."""
    joined = F.concat_ws(" ", *[blank_to_null(c) for c in fallbacks])
    return F.coalesce(*[blank_to_null(c) for c in candidates], blank_to_null(joined), F.lit("No content available"))


def is_japanese(text: Column, share: float = 0.1) -> Column:
    """Whether more than the given share of the characters is kana or kanji."""
    return F.coalesce(F.regexp_count(text, F.lit(KANA_KANJI)) > F.length(text) * share, F.lit(False))


def japanese_normal(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, FULL_WIDTH, HALF_WIDTH), SYMBOLS, "")


def preprocess(text: Column, mode: str = "faithful") -> Column:
    """Entities replaced in order and the ends trimmed; ``intended`` also collapses white space first."""
    out = F.coalesce(text, F.lit(""))
    # as written the collapse looks for a backslash followed by letters s
    out = F.regexp_replace(out, r"\\s+", " ") if mode == "faithful" else F.regexp_replace(out, r"\s+", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.when(is_japanese(out), japanese_normal(out)).otherwise(out))


def keywords(title_: Column, content: Column, meta: Column | None = None, mode: str = "faithful") -> Column:
    """Sorted distinct keywords of 2 to 50 characters, twenty at most.

    In ``faithful`` mode the title is split by a class that, as written,
    holds the range from backslash to dash; ``intended`` splits at separators.
    """
    separators = "[|\\\\-—–:：｜]" if mode == "faithful" else "[|\\-—–:：｜]"
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    from_title = F.filter(F.transform(F.split(title_, separators), strip), lambda k: F.length(k) > 2)
    first = F.transform(F.slice(F.regexp_extract_all(content, F.lit(r"\b([A-Za-z]{3,})\b")), 1, FIRST_WORDS), lambda w: F.lower(w))
    parts = [F.coalesce(from_title, F.array().cast("array<string>")), F.coalesce(first, F.array().cast("array<string>"))]
    if meta is not None:
        parts.append(F.coalesce(F.filter(F.transform(F.split(meta, ","), strip), lambda k: k != ""), F.array().cast("array<string>")))
    every = F.array_distinct(F.concat(*parts))
    return F.slice(F.array_sort(F.filter(every, lambda k: F.length(k).between(2, 50))), 1, MOST_KEYWORDS)


def categories(title_: Column, content: Column, domain: Column) -> Column:
    """Sorted distinct categories, by exact domain and by substrings of title and content."""
    text = F.concat_ws(" ", F.lower(title_), F.lower(content))
    found = [F.when(text.rlike("|".join(words)), F.lit(name)) for name, words in CATEGORY_WORDS.items()]
    by_domain = F.lit(None).cast("array<string>")
    for host, names in DOMAIN_CATEGORIES.items():
        by_domain = F.when(domain == host, F.array(*map(F.lit, names))).otherwise(by_domain)
    every = F.concat(F.coalesce(by_domain, F.array().cast("array<string>")), F.array_compact(F.array(*found)))
    return F.array_sort(F.array_distinct(every))


def published_at(dates: Column) -> Column:
    """The first date string that one of the formats reads; without a zone it is UTC."""
    read = F.transform(dates, lambda d: F.coalesce(*[F.try_to_timestamp(d, F.lit(f)) for f in DATE_FORMATS]))
    return F.try_element_at(F.array_compact(read), F.lit(1))


def last_modified(text: Column) -> Column:
    t = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS[2:6]])


def sitemap_priority(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def snippet(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def truncated(text: Column, most: int = 8192, least: float = 0.8) -> Column:
    """At most ``most`` characters, back to the last space if that lies beyond the given share."""
    cut = F.substring(text, 1, most)
    space = F.lit(most) - F.instr(F.reverse(cut), " ")
    back = F.when((F.instr(F.reverse(cut), " ") > 0) & (space > most * least), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(back)


def token_estimate(text: Column) -> Column:
    ja = F.regexp_count(text, F.lit(KANA_KANJI))
    return F.floor((F.length(text) - ja) / 4 + ja / 2).cast("long")


def optimal_chunk(length: Column, target: int, most: int) -> Column:
    return F.least(length, F.lit(most)) if target <= 1 else F.least(F.floor(length / target), F.lit(most).cast("long"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(words / 200))


def tokens(text: Column) -> Column:
    """Words of the standard analyzer: runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))
