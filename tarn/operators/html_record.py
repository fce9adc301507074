"""HTML pages to structured records: text, metadata, links, images, dates.

A small tree is built with the standard library's parser; boilerplate goes by
tag and by class or id, the main part is chosen by selectors in order, and
all fields are read from what is left.  One Arrow pass, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is removed, in which order the main part is looked for, and where dates are.
REMOVED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "advertisement", "ads", "sidebar", "menu", "form", "button", "input", "select", "textarea")
REMOVED_NAMES = re.compile("nav|menu|sidebar|footer|header|advertisement|ads|social|share|comment|popup|modal|breadcrumb|pagination|tags", re.I)
MAIN_TAGS = ("main", "article")
MAIN_CLASSES = ("content", "main-content", "post-content", "entry-content", "article-content", "page-content")
DATE_NAMES = ("date", "publish-date", "publication-date")
DATE_PROPERTIES = ("article:published_time", "article:modified_time")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MOST_LINKS, MOST_IMAGES, LEAST_MAIN = 50, 20, 100
#: Pages whose records a worker holds at once.
PAGES_AT_ONCE = 200
#: Rows of links by domain that leave a worker at once.
DOMAINS_AT_ONCE = 10_000

RECORD = (
    "title string, description string, body_text string, html_lang string, author string, opengraph map<string,string>, twitter map<string,string>, "
    "structured array<string>, publication_dates array<string>, word_count long, reading_minutes long, "
    "links array<struct<url:string,text:string,domain:string>>, total_links long, images array<struct<url:string,alt:string,title:string>>, total_images long, error string"
)


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in page order; deep pages need no recursion."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def strings(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    stack.append(iter(c.children))
                    break
                yield c
            else:
                stack.pop()

    def text(self) -> str:
        return "".join(self.strings())


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def resolved(href: str, url: str) -> tuple[str, str | None]:
    """A link's whole URL, and its domain where it is of http or https."""
    whole = href if href.startswith(("http://", "https://")) else urljoin(url, href)
    return whole, urlsplit(whole).netloc.lower().split(":")[0] or None if whole.startswith("http") else None


class Anchors(HTMLParser):
    """All links of a page by their domain, menus included, without a tree."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.domains = url, Counter()

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            try:
                domain = resolved(href, self.url)[1]
            except ValueError:
                # such a link leads nowhere; the page's others do
                return
            if domain:
                self.domains[domain] += 1

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            # an unknown section is a comment, as in HTML
            return self.parse_bogus_comment(i, report)


def _prune(node: Node, bad) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if not (isinstance(c, Node) and bad(c))]
        stack += [c for c in n.children if isinstance(c, Node)]


def parse(html: str, url: str, mode: str = "faithful", references: tuple[str, ...] | None = None) -> dict:
    """The record of one page.

    ``faithful`` reads metadata after boilerplate is gone, so structured data
    in scripts and links in menus are not seen; ``intended`` reads it before.
    With ``references`` only these character references are decoded, and only
    where a semicolon ends them; by default all that HTML knows.
    """
    builder = Builder()
    if references is not None:
        # any other ampersand stands for itself
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", html)
    builder.feed(html)
    builder.close()
    root = builder.root
    before = list(root.walk()) if mode == "intended" else None
    structured = [n.text().strip() for n in before or () if n.name == "script" and n.attrs.get("type") == "application/ld+json"]
    _prune(root, lambda n: n.name in REMOVED_TAGS)
    _prune(root, lambda n: n.name not in ("html", "body") and any(REMOVED_NAMES.search(n.attrs.get(k, "")) for k in ("class", "id")))
    nodes = list(root.walk())
    seen = before or nodes

    def first(test):
        return next((n for n in nodes if test(n)), None)

    tests = [*[lambda n, t=t: n.name == t for t in MAIN_TAGS], lambda n: n.attrs.get("role") == "main", *[lambda n, c=c: c in n.attrs.get("class", "").split() for c in MAIN_CLASSES]]
    main = next((m for t in tests if (m := first(t)) is not None and len(m.text().strip()) > LEAST_MAIN), None) or first(lambda n: n.name == "body") or root
    body = " ".join(" ".join(s.split()) for s in main.strings() if s.strip())

    metas = [n.attrs for n in seen if n.name == "meta"]

    def meta(key, value):
        return next((m.get("content") or None for m in metas if m.get(key) == value), None)

    def heading(tag):
        n = next((n for n in seen if n.name == tag), None)
        return (n.text().strip() or None) if n else None

    og = {m["property"][3:]: m.get("content", "") for m in metas if m.get("property", "").startswith("og:")}
    twitter = {m["name"][8:]: m.get("content", "") for m in metas if m.get("name", "").startswith("twitter:")}
    dates = [v for name in DATE_NAMES for m in metas if m.get("name") == name and (v := m.get("content"))]
    dates += [v for name in DATE_PROPERTIES for m in metas if m.get("property") == name and (v := m.get("content"))]
    dates += [v for n in seen if n.name == "time" and (v := n.attrs.get("datetime"))]
    links = []
    for n in seen:
        if n.name == "a" and n.attrs.get("href"):
            whole, domain = resolved(n.attrs["href"], url)
            links.append({"url": whole, "text": n.text().strip(), "domain": domain})
    images = [{"url": urljoin(url, n.attrs["src"]), "alt": n.attrs.get("alt", ""), "title": n.attrs.get("title", "")} for n in seen if n.name == "img" and n.attrs.get("src")]
    page = next((n for n in seen if n.name == "html"), None)
    words = len(root.text().split())
    return {
        "title": og.get("title") or heading("title") or heading("h1"),
        "description": meta("name", "description") or og.get("description"),
        "body_text": body,
        "html_lang": page.attrs.get("lang") if page else None,
        "author": meta("name", "author") or meta("property", "article:author"),
        "opengraph": og or None,
        "twitter": twitter or None,
        "structured": structured,
        "publication_dates": dates,
        "word_count": words,
        "reading_minutes": max(1, words // 200),
        "links": links[:MOST_LINKS],
        "total_links": len(links),
        "images": images[:MOST_IMAGES],
        "total_images": len(images),
        "error": None,
    }


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", mode: str = "faithful", references: tuple[str, ...] | None = None) -> DataFrame:
    """(key, url, record fields) per page; a page that fails has null fields and its error."""
    kept = pages.select(F.col(key), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, url string, {RECORD}"
    names = [x.split()[0] for x in re.sub(r"<[^<>]*(<[^<>]*>[^<>]*)*>", "", RECORD).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PAGES_AT_ONCE):
                b, out = whole.iloc[at : at + PAGES_AT_ONCE], []
                for k, u, h in zip(b[key], b["url"], b["html"], strict=True):
                    try:
                        r = parse(h or "", u or "", mode, references)
                    except (ValueError, AssertionError) as e:
                        r = dict.fromkeys(names) | {"error": str(e)}
                    out.append({key: k, "url": u} | r)
                yield pd.DataFrame(out, columns=[key, "url", *names])

    return kept.mapInPandas(run, schema)


def link_domains(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, domain, n): how many of a page's links lead to each domain; all links count, where a record names the first 50."""

    def counted(u: str | None, h: str | None) -> Counter:
        anchors = Anchors(u or "")
        anchors.feed(h or "")
        anchors.close()
        return anchors.domains

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((u, d, n) for b in batches for u, h in zip(b["url"], b["html"], strict=True) for d, n in counted(u, h).items())
        while part := list(islice(rows, DOMAINS_AT_ONCE)):
            yield pd.DataFrame(part, columns=["url", "domain", "n"])

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, domain string, n long")


def decoded(raw, charset=None):
    """Bytes to text: the given charset or UTF-8, else Latin-1 (which never fails)."""
    if charset is not None:
        return F.when(charset == "iso-8859-1", F.decode(raw, "ISO-8859-1")).otherwise(F.decode(raw, "UTF-8"))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
