"""URL algebra as column expressions.

Everything here is built-in expressions, so it stays inside code generation;
only ``resolve`` goes to Python, for relative references that no built-in
covers, and ``normalize_exact``, which says the same as ``normalize``.
"""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# File name endings that are never crawled, and those that are left out of the frontier.
FRONTIER_EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "tar", "gz", "jpg", "jpeg", "png", "gif",
    "bmp", "svg", "webp", "mp3", "mp4", "avi", "mov", "wmv", "flv", "css", "js", "ico", "woff", "woff2", "ttf", "eot",
)
NOT_CRAWLABLE = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "jpg", "jpeg", "png", "gif", "svg", "webp", "mp3", "mp4", "avi",
    "mov", "wmv", "flv", "zip", "rar", "tar", "gz", "7z", "exe", "dmg", "pkg", "deb", "rpm", "css", "js", "json", "csv", "sql",
)
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml", "/sitemap/index.xml")
PROBED_SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml", "/sitemaps/sitemap.xml")
MAX_URL = 2048
#: What may surround a URL: control characters and blanks.
BLANKS = "".join(map(chr, range(33)))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def is_valid(url: Column) -> Column:
    """http or https with a host; null is not valid."""
    return F.coalesce(scheme(url).isin("http", "https") & (netloc(url) != ""), F.lit(False))


def domain(url: Column) -> Column:
    """Host in lower case without port (user information stays); null if there is none."""
    return F.nullif(F.split_part(netloc(url), F.lit(":"), F.lit(1)), F.lit(""))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":([0-9]+)$", 1).try_cast("int")


def depth(url: Column) -> Column:
    """Segments of the path without its outer slashes; inner empty ones count."""
    p = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(domain(a) == domain(b), F.lit(False))


def is_sitemap(url: Column) -> Column:
    return F.lower(url).contains("sitemap")


def is_address(host: Column) -> Column:
    return F.coalesce(host.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$") | host.rlike(r"^\[?[0-9a-fA-F:]*:[0-9a-fA-F:]+\]?$"), F.lit(False))


def included(url: Column) -> Column:
    """The frontier's filter: length, scheme, and no excluded ending of the whole URL."""
    ends = r"\.(" + "|".join(FRONTIER_EXTENSIONS) + ")$"
    return F.coalesce((F.length(url) > 0) & (F.length(url) <= MAX_URL) & F.lower(url).rlike("^https?://") & ~F.lower(url).rlike(ends), F.lit(False))


def crawlable(url: Column) -> Column:
    """By the ending after the path's last dot; a last segment without a dot, or an unknown ending, is crawlable."""
    p = F.lower(path(url))
    last = F.element_at(F.split(p, "/"), -1)
    return F.when(~last.contains("."), True).otherwise(~F.element_at(F.split(p, r"\."), -1).isin(*NOT_CRAWLABLE))


def _decoded(x: Column) -> Column:
    """A form-encoded name or value in plain; a per cent sign without two digits stands for itself."""
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    """Form encoding in which letters, digits and ``_.-~`` stay, blanks become plus signs."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parameters(query: Column) -> Column:
    """Names and values of a query string in plain, sorted; the value is all that follows the first equals sign."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    name = lambda x: F.substring_index(x, "=", 1)
    return F.array_sort(F.transform(parts, lambda x: F.struct(_decoded(name(x)).alias("k"), _decoded(F.substring(x, F.length(name(x)) + 2, F.length(x))).alias("v"))))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, trailing slashes cut, parameters decoded, sorted and encoded again.

    Null if the URL is not valid.
    """
    url = F.translate(F.btrim(url, F.lit(BLANKS)), "\t\r\n", "")
    s, n, p, q = scheme(url), netloc(url), path(url), query_string(url)
    host = F.when(s == "http", F.regexp_replace(n, ":80$", "")).otherwise(F.regexp_replace(n, ":443$", ""))
    clean = F.when((p == "") | (p == "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    params = F.array_join(F.transform(parameters(q), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    return F.when(is_valid(url), F.concat(s, F.lit("://"), host, clean, F.when(q == "", "").when(params != "", F.concat(F.lit("?"), params)).otherwise("")))


def _normalize_one(url: str | None) -> str | None:
    if url is None:
        return None
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return None
    kind, host = parts.scheme.lower(), parts.netloc.lower()
    if kind not in ("http", "https") or not host:
        return None
    default = ":80" if kind == "http" else ":443"
    host = host.removesuffix(default)
    where = parts.path or "/"
    if where != "/":
        where = where.rstrip("/")
    params = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return urlunsplit((kind, host, where, params, ""))


@F.pandas_udf(StringType())
def normalize_exact(url: pd.Series) -> pd.Series:
    """``normalize`` by the standard library, a value at a time."""
    return url.map(_normalize_one)


@F.pandas_udf(StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link against its page's URL; null if the result is not an http(s) URL."""

    def one(b, k):
        try:
            found = urljoin(b, k)
            parts = urlsplit(found)
        except (ValueError, TypeError):
            return None
        return found if parts.scheme in ("http", "https") and parts.netloc else None

    return pd.Series([one(b, k) for b, k in zip(base, link, strict=True)], dtype=object)


def url_hash(url: Column) -> Column:
    return F.sha2(F.coalesce(normalize(url), url), 256)


def document_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def sitemap_candidates(host: Column, kind: str = "https", paths: tuple[str, ...] = SITEMAP_PATHS) -> Column:
    return F.array(*[F.concat(F.lit(f"{kind}://"), host, F.lit(p)) for p in paths])


def robots_url(host: Column, kind: str = "https") -> Column:
    return F.concat(F.lit(f"{kind}://"), host, F.lit("/robots.txt"))


def object_key(kind: str, url: Column, at: Column) -> Column:
    """Place of a stored object: type, date, domain, hash of the URL."""
    prefix, ending = {"raw": ("raw-html", "html.gz"), "parsed": ("parsed-content", "json.gz")}.get(kind, (kind, kind))
    return F.concat_ws("/", F.lit(prefix), F.date_format(at, "yyyy/MM/dd"), domain(url), F.concat(url_hash(url), F.lit(f".{ending}")))
