"""HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags.  Elements that are never part
of an article (scripts, menus, forms, side bars, notices, adverts, comments)
are set aside by tag, role and class: a container by any part of its class
name outside an article; a paragraph, and everything inside an article, only
if the whole name says so (``related-posts``, but not ``related-work`` or
``notice-board-story``).  Of the elements inside a paragraph only hidden ones
go, whatever their names.

The first pass decides the other blocks by length, stop-word density and link
density; short or unclear blocks stay open, and so do short linked ones inside
an article, which may well be part of it.  In the second pass an open block
takes the label of its nearest decided neighbours.  Inside an article it takes
that of both, or if they differ of the nearer one (of equally near ones good).
On a page without an article it is good if both are, if it is a heading right
before good text, or if the good one shares its container and the other one
does not; the page's edges count as bad.  Beside an article, blocks that the
first pass finds good stay as far as they join it without a break.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_texts

SCHEMA = "text string, n_chars long, n_blocks int, n_dropped int"

STOP_WORDS = frozenset(
    """
    the of and to a in is that it for was on as be with by at this from are or an not which have he his but they we you
    de la le les et des en un une du que est dans qui pour pas sur au par plus avec ce se il elle ne sont aux ou
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    el los las del que y en un una por con no para su al lo como más o pero sus le ha me si sin sobre este ya
    """.split()
)
LEAST_LENGTH = 60
GOOD_DENSITY = 0.20
BAD_LINKS = 0.5

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
CONTAINERS = {
    "html", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "ul", "ol", "dl", "table",
    "figure", "dialog", "details", "fieldset", "menu", "select", "button", "head", "address", "hgroup", "search", "blockquote",
}
BLOCKS = CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "caption", "thead", "tbody", "tfoot", "pre",
    "figcaption", "summary", "legend", "hr", "option", "optgroup", "center",
}
DROPPED_TAGS = {"nav", "aside", "footer", "form", "dialog", "menu", "select", "button", "head", "fieldset", "search"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|"
    r"sidebar|side-?bar|aside|footer|site-?header|masthead|topbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscribe|subscription|signup|login|widget|pagination|pager|toolbar|skip|copyright|tags?)(?:$|[\s_-]|\d)",
    re.I,
)
#: Parts that may stand beside a dropped name without changing what it says.
PLAIN_PARTS = frozenset(
    """
    area articles bar block body bottom box button buttons center col column container content copy footer form global group
    header holder icon icons id inner item items label left line link links list main mobile news outer page pane panel post posts primary right
    row secondary section site slot small sticky stories text title top unit wrap wrapper zone
    """.split()
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|head)(?:$|[\s_-])", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|post-?(?:body|content)|entry-?content|main-?content|story(?:-?body)?)(?:$|[\s_-])", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    links: int = 0
    zone: int = -1
    parent: int = 0
    heading: bool = False
    dropped: bool = False
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name, of equal names the first; one without a value has the empty one."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw) if raw.strip(" /") else ():
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _wholly(names: str) -> bool:
    """Whether one of the class names is made of dropped names and plain parts only."""
    for one in names.split():
        said = False
        for part in re.split(r"[-_]+", one):
            if DROPPED_NAMES.search(part):
                said = True
            elif part and part.lower() not in PLAIN_PARTS and not part.isdigit():
                break
        else:
            if said:
                return True
    return False


def _drops(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in DROPPED_TAGS or name == "header" and not in_article:
        return True
    if not attrs:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if attrs.get("role", "").lower() in DROPPED_ROLES or _hidden(attrs):
        return True
    if name in ("html", "body", "article", "main"):
        # of the page's frame and the article itself only an explicit comment class counts
        return name == "article" and re.search(r"comment|repl(?:y|ies)", names, re.I) is not None
    if in_article or name not in CONTAINERS:
        return _wholly(names)
    return bool(DROPPED_NAMES.search(names)) or not in_article and bool(HEADER_NAMES.search(names))


def blocks_of(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    found: list[Block] = []
    block = Block()
    stack: list[tuple[str, bool, int, int]] = []  # open containers: name, dropped, zone, number
    inline: list[str] = []  # open inline elements that are set aside
    links = zones = numbers = 0
    piece_dropped = False  # the open paragraph-like element is set aside

    def close(heading: bool = False) -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                found.append(block)
        block = Block(heading=heading)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        end = n if lt < 0 else lt
        if end > at and not inline:
            dropped = piece_dropped or bool(stack and stack[-1][1])
            zone = stack[-1][2] if stack else -1
            if block.parts and (block.dropped != dropped or block.zone != zone):
                close(block.heading)
            text = page[at:end]
            block.dropped, block.zone, block.parent = dropped, zone, stack[-1][3] if stack else 0
            block.parts.append(text)
            if links:
                block.links += len(text.strip())
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", lt):
            stop = page.find("]]>", lt)
            at = n if stop < 0 else stop + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if m is None:
            if not inline:
                block.parts.append("&lt;")
                block.dropped = piece_dropped or bool(stack and stack[-1][1])
                block.zone, block.parent = stack[-1][2:] if stack else (-1, 0)
            at = lt + 1
            continue
        at = m.end()
        closing, name, raw = bool(m[1]), m[2].lower(), m[3]
        if name in RAW:
            if not closing and not raw.endswith("/"):
                stop = re.compile(rf"</{name}\s*/?\s*>?", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br" or name == "wbr":
            block.parts.append(" " if name == "br" else "")
            continue
        if name not in BLOCKS:
            if closing:
                if name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name) :]
            elif raw and not raw.endswith("/") and name != "img" and name != "input" and name != "link" and name != "meta":
                if _hidden(_attributes(raw)):
                    inline.append(name)
            continue
        heading = len(name) == 2 and name[0] == "h" and name[1] in "123456" and not closing
        close(heading)
        inline.clear()
        links = 0
        piece_dropped = False
        if name in CONTAINERS:
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif not raw.endswith("/"):
                attrs = _attributes(raw)
                up_dropped, zone = (stack[-1][1], stack[-1][2]) if stack else (False, -1)
                if name == "body":
                    # an unclosed head ends here
                    stack = [x for x in stack if x[0] != "head"]
                    up_dropped = bool(stack and stack[-1][1])
                dropped = up_dropped or _drops(name, attrs, zone >= 0)
                names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
                if not dropped and zone < 0 and (name in ("article", "main") or attrs.get("role") in ("main", "article") or ARTICLE_NAMES.search(names)):
                    zone, zones = zones, zones + 1
                numbers += 1
                stack.append((name, dropped, zone, numbers))
        elif not closing:
            piece_dropped = bool(raw) and _drops(name, _attributes(raw), bool(stack) and stack[-1][2] >= 0)
    close()
    return found


GOOD, BAD, OPEN = 1, -1, 0


def first_pass(b: Block) -> int:
    if b.dropped:
        return BAD
    length = len(b.text)
    linked = b.links / length > BAD_LINKS
    if linked and b.zone < 0:
        return BAD
    if length < LEAST_LENGTH or b.heading:
        return OPEN
    words = WORD.findall(b.text.lower())
    if words and sum(w in STOP_WORDS for w in words) / len(words) >= GOOD_DENSITY:
        return OPEN if linked else GOOD
    return BAD if linked else OPEN


def _inside(blocks: list[Block], labels: list[int]) -> list[int]:
    """Labels of a page with an article: open blocks by their neighbours in the same article, then what joins it."""
    final, n = list(labels), len(blocks)
    # the nearest decided block of the same article on either side: (label, distance)
    before, after = [(OPEN, n)] * n, [(OPEN, n)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, int]] = {}
        for i in order:
            b = blocks[i]
            if b.zone in last:
                label, at = last[b.zone]
                side[i] = label, abs(i - at)
            # an element set aside within an article says nothing about its neighbours
            if labels[i] != OPEN and not b.dropped and b.zone >= 0:
                last[b.zone] = labels[i], i
    any_good = {b.zone for b, x in zip(blocks, labels, strict=True) if x == GOOD}
    for i, b in enumerate(blocks):
        if b.zone < 0:
            final[i] = BAD
        elif labels[i] == OPEN:
            near = min((d, -x) for x, d in (before[i], after[i]))
            final[i] = BAD if b.zone in any_good and near[1] == -BAD else GOOD
    # good blocks beside an article, outwards from its ends
    for order in (range(1, n), range(n - 2, -1, -1)):
        for i in order:
            beside = i - order.step
            if blocks[i].zone < 0 and labels[i] == GOOD and final[beside] == GOOD:
                final[i] = GOOD
    return final


def _outside(blocks: list[Block], labels: list[int]) -> list[int]:
    """Labels of a page without an article: open blocks by their neighbours and containers; the page's edges are bad."""
    final, n = list(labels), len(blocks)
    before, after = [(BAD, -1)] * n, [(BAD, -1)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = BAD, -1
        for i in order:
            side[i] = last
            if labels[i] != OPEN:
                last = labels[i], blocks[i].parent
    for i, b in enumerate(blocks):
        if labels[i] == OPEN:
            sides = before[i], after[i]
            good = [parent == b.parent for label, parent in sides if label == GOOD]
            bad = [parent == b.parent for label, parent in sides if label == BAD]
            final[i] = GOOD if len(good) == 2 or b.heading and after[i][0] == GOOD or good == [True] and bad == [False] else BAD
    if GOOD not in final:
        # nothing was decided: a page of short text only
        final = [GOOD if x == OPEN else BAD for x in labels]
    return final


def extract(page: str | None) -> tuple[str, int, int]:
    """(text, blocks kept, blocks left out)."""
    if not page:
        return "", 0, 0
    blocks = blocks_of(page)
    labels = [first_pass(b) for b in blocks]
    rule = _inside if any(b.zone >= 0 and not b.dropped for b in blocks) else _outside
    final = rule(blocks, labels)
    kept = [b.text for b, x in zip(blocks, final, strict=True) if x == GOOD]
    return "\n".join(kept), len(kept), len(blocks) - len(kept)


def html_text(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """(keys, text, n_chars, n_blocks, n_dropped) per page.

    A null, empty or textless page gives the empty text.  Broken markup (open
    tags, stray brackets, unclosed comments) never fails; the rest of an
    unclosed script, style or comment is left out, as browsers do.  Pages are
    taken whole, each by itself: repeated rows give repeated rows.
    """

    def work(pages: list[str | None]) -> dict:
        rows = [extract(p) for p in pages]
        return {
            "text": [r[0] for r in rows],
            "n_chars": [len(r[0]) for r in rows],
            "n_blocks": [r[1] for r in rows],
            "n_dropped": [r[2] for r in rows],
        }

    return map_texts(df.select(*[F.col(f"`{k}`") for k in (*keys, page)]), list(keys), page, SCHEMA, work)
