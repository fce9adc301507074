"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

The base rules find well-formed e-mail addresses, IPv4 addresses, payment
cards and international phone numbers exactly.  Beyond those, generators
propose overlapping spans that may hide the same kinds (spelled-out e-mail
signs, bracketed dots, odd digit groups, account numbers that fail the check
digit, local phone formats) or a secret (tokens, keys).  Boosted trees
score each by its format and the words around it; the model is trained once
on the driver from seeded examples (a bounded number, ``EXAMPLES``), its
margin is calibrated on examples kept apart, and the threshold of each kind
is the least score that keeps the asked precision there.  Accepted spans
never overlap a base span; of overlapping ones the likeliest stays.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.boosting import Boosted, calibrate, fit
from tarn.llm.common import map_rows, map_texts

#: Kinds with base rules, and all kinds in the order of the span list.
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
EXAMPLES = 8000
PRECISION = 0.995
SEED = 20_240_601

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ISLAND = re.compile(r"[0-9][0-9.]*")  # digits and dots only, so that no scan starts twice
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All base spans by (start, kind in order); each kind leftmost and without overlap."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            begin = at
            while begin > end and text[begin - 1] in _LOCAL:
                begin -= 1
            m = _DOMAIN.match(text, at + 1) if begin < at else None
            if m:
                end = m.end()
                out.append((begin, end, "email"))
        at = text.find("@", at + 1)
    first = _DIGIT.search(text)
    if first is None:
        return out
    for island in _ISLAND.finditer(text, first.start()):
        if island[0].count(".") < 3:
            continue
        for m in _DOTTED.finditer(island[0]):
            parts = m[0].split(".")
            begin = island.start() + m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                stop = begin + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((begin, stop, "ip"))
                begin = stop + 1
    for m in _CARD.finditer(text, first.start()):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


# ---- candidates -------------------------------------------------------------------------------------

_AT = r"(?:@|\s?[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_SPELLED = re.compile(rf"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
_SPELLED_SIGN = re.compile(r"(?i)[\[({<]\s?(?:dot|at|\.|@)\s?[\])}>]|\sdot\s")
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[(]?\s?\.\s?[\])]?\s?[0-9]{1,3}){3}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20./_ -]{0,2}[0-9]){12,18}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\(\+?[0-9]{1,4}\)|00[0-9]{1,3}|[0-9]{2,5})(?:[\x20./ -]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])")
CUES = {
    "email": ("mail", "contact", "write", "reach", "address", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "address", "login", "client", "connect"),
    "card": ("card", "visa", "master", "credit", "pay", "carte", "karte", "tarjeta", "amex"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "handy", "llam", "appel", "ruf"),
    "secret": ("token", "key", "secret", "passw", "auth", "bearer", "credential", "signature"),
}
AGAINST = ("version", "isbn", "order", "ref", "invoice", "page", "date", "id", "section", "serial", "year", "chapter", "commit", "checksum", "digest", "build", "hash", "file")
_AGAINST = re.compile(rf"\b(?:{'|'.join(AGAINST)})\b")
#: Characters of tokens and keys.
_TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_TOKEN_TAIL = re.compile(r"[A-Za-z0-9+/_-]*={0,2}")
LEAST_SECRET = 16


def _secrets(text: str) -> list[Span]:
    """Long runs of token characters with a digit and a letter, found from their digits."""
    out, end = [], 0
    for m in _DIGIT.finditer(text):
        if m.start() < end:
            continue
        before = text[end : m.start()]
        begin = m.start() - (len(before) - len(before.rstrip(_TOKEN)))
        end = _TOKEN_TAIL.match(text, m.start()).end()
        if end - begin >= LEAST_SECRET and any(c.isalpha() for c in text[begin:end]):
            out.append((begin, end, "secret"))
    return out


def candidates(text: str) -> list[Span]:
    """Spans worth scoring, overlapping ones included."""
    out: list[Span] = []
    if _SPELLED_SIGN.search(text):
        out += [(m.start(), m.end(), "email") for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        for pattern, kind in ((_LOOSE_IP, "ip"), (_LOOSE_CARD, "card"), (_LOOSE_PHONE, "phone")):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
        out += _secrets(text)
    return out


def features(text: str, span: Span) -> list[float]:
    begin, end, kind = span
    body = text[begin:end]
    before, after = text[max(0, begin - 40) : begin].lower(), text[end : end + 20].lower()
    digits = _digits(body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    numbers = [int(g) for g in re.findall(r"[0-9]{1,6}", body)]
    cue = [sum(c in before for c in CUES[k]) for k in ALL]
    near = before[-14:]
    share = np.array(list(Counter(body).values())) / len(body)
    return [
        *(float(kind == k) for k in ALL),
        len(body),
        len(digits),
        float(luhn(digits)) if len(digits) >= 12 else 0.0,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        float(len(set(groups)) == 1),
        float(bool(numbers) and max(numbers) <= 255),
        sum(c.isalpha() for c in body) / len(body),
        sum(c in "[](){}<>" for c in body),
        body.count("."),
        body.count("-") + body.count("/"),
        body.count(" "),
        float(re.search(r"(?i)\bat\b|@", body) is not None),
        float(re.search(r"(?i)[\[({<]\s?(at|dot|\.|@)\s?[\])}>]", body) is not None),
        float(re.search(r"(?i)(dot|\.)\W*(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", body) is not None),
        float(body.startswith(("0", "("))),
        float(re.fullmatch(r"(19|20)[0-9]{2}\D.*|.*\D(19|20)[0-9]{2}", body) is not None),
        cue[ALL.index(kind)],
        sum(cue) - cue[ALL.index(kind)],
        len(_AGAINST.findall(before)),
        float(before[-1:].isalnum() or after[:1].isalnum()),
        float(near.rstrip("\"' ").endswith((":", "=", "#"))),
        float(-(share * np.log2(share)).sum()),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body) is not None),
        len(re.findall(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", body)) / len(body),
        body.count("-") + body.count("_") + body.count("/"),
        float(after[:1] in "%€$£" and bool(after)) + float(before.rstrip()[-1:] in "%€$£" and bool(before.rstrip())),
    ]


# ---- training ---------------------------------------------------------------------------------------


def _examples(n: int, seed: int) -> list[tuple[str, str, bool]]:
    """(text, kind of the hidden span, whether it is personal); made from templates by a seeded generator."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "st", "lo", "mi", "ta", "re", "on", "de", "li"]) for _ in range(r.randint(1, 4)))
    filler = lambda k: " ".join(word() for _ in range(k))

    def card(k=16, good=True):
        body = d(k - 1)
        for c in "0123456789":
            if luhn(body + c) == good:
                return body + c
        return body

    out = []
    for _ in range(n):
        kind, personal = r.choice(ALL), r.random() < 0.5
        cued = {"card": 0.5, "secret": 0.7}.get(kind, 0.8)
        cue = r.choice(CUES[kind]) if r.random() < (cued if personal else 0.05) else word()
        against = r.choice(AGAINST) if not personal and r.random() < 0.4 else ""
        sign = r.choice([": ", " ", " = "])
        quote = ""
        if kind == "email":
            if personal:
                at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" AT ", " DOT "), (" {at} ", "."), (" @ ", " [.] ")])
                body = f"{word()}{r.choice(['', '.', '_'])}{word()}{at if at != ' @ ' else '[@]'}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu'])}"
            else:
                body = r.choice([f"{word()} at {word()} dot {word()} {word()}", f"{word()} at {word()}.{word()}", f"{word()} (at) {word()}. {word()} dot {word()}", f"{word()} at the dot {word()}"])
        elif kind == "ip":
            four = [r.randint(1, 255) for _ in range(4)]
            if personal:
                body = r.choice(["[.]", "(.)", " . ", " [.] "]).join(map(str, four))
            else:
                body = r.choice([". ".join(d(r.randint(1, 3)) for _ in range(4)), ".".join([*map(str, four[:3]), str(r.randint(256, 999))]), " .".join(d(1) for _ in range(4))])
                sign, cue = r.choice([" ", ", "]), r.choice(["version", "section", word()])
        elif kind == "card":
            # of numbers as long as a card's or an account's one may be anybody's, check digit or not
            k = r.choice([15, 16, 16, 16])
            c = card(k, r.random() < 0.5)
            if personal:
                body = r.choice(["", "", "", ".", "/", "  ", "_", "- "]).join(c[i : i + 4] for i in range(0, k, 4))
            else:
                against = against or r.choice(AGAINST)
                body = r.choice([c, d(16), "/".join(c[i : i + 4] for i in range(0, k, 4)), d(r.choice([13, 14, 17, 18, 19])), ".".join(d(3) for _ in range(5))])
        elif kind == "secret":
            mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
            hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
            upper = r.random() < 0.1
            if personal:
                quote = r.choice(["", '"', "'"])
                body = r.choice([hexed(r.choice([32, 40, 48, 64])), hexed(40), mixed(r.randint(20, 60)), f"sk_{mixed(32)}", f"pk-{mixed(24)}", f"{mixed(20)}/{mixed(19)}", mixed(42) + "=="])
            else:
                body = r.choice(
                    [
                        f"{word()}{d(2)}-{word()}-{word()}-{word()}{d(1)}",
                        f"{word()}_{word()}_{word()}_{r.randint(1900, 2029)}",
                        f"{word()}/{word()}/{word()}/{word()}{d(2)}",
                        f"{word()}{word()}{word()}{word()}{d(r.randint(1, 3))}",
                        f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}",
                        hexed(r.choice([32, 40, 64])),
                    ]
                )
                if re.fullmatch(r"[0-9a-f-]+", body):
                    against = against or r.choice(["commit", "checksum", "digest", "hash", "file", "build", "id"])
            body = body.upper() if upper else body
        else:
            if personal:
                body = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(4)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}/{d(4)} {d(3)}"])
            else:
                body = r.choice([f"{r.randint(1900, 2029)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1900, 2029)}", f"{d(2)}.{d(2)}", f"{d(3)} {d(3)}", f"{d(5)} {d(5)} {d(5)}", f"{d(7)} {d(7)}", f"{d(2)}-{d(2)}", f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(2)}", f"{d(4)} {d(4)}", f"{d(2)} {d(3)} {d(2)} {d(4)}"])
        lead = filler(r.randint(2, 8))
        text = f"{lead} {against + ' ' if against else ''}{cue}{sign}{quote}{body}{quote} {filler(r.randint(2, 6))}"
        out.append((text, body, personal and (not against)))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees and the threshold of each kind."""

    def table(n, seed):
        xs, ys, kinds = [], [], []
        for text, body, personal in _examples(n, seed):
            at = text.find(body)
            for s in candidates(text):
                whole = s[0] <= at + 1 and s[1] >= at + len(body) - 1
                xs.append(features(text, s))
                ys.append(float(personal and whole))
                kinds.append(s[2])
        return np.array(xs), np.array(ys), np.array(kinds)

    x, y, _ = table(EXAMPLES // 2, SEED)
    trees = fit(x, y)
    x, y, kinds = table(EXAMPLES // 4, SEED + 1)
    calibrate(trees, x, y)
    x, y, kinds = table(EXAMPLES // 4, SEED + 2)
    p = trees.probability(x)
    limits = {}
    for k in ALL:
        mine = kinds == k
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        ok = np.flatnonzero(right >= PRECISION)
        limits[k] = max(0.9, float(p[mine][order][ok[-1]])) if len(ok) else 2.0
    return trees, limits


class _Taken:
    """Disjoint intervals, to ask whether a span meets one of them."""

    def __init__(self, spans: list[Span]):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)

    def meets(self, s: Span) -> bool:
        return bisect_left(self.begins, s[1]) > bisect_right(self.ends, s[0])

    def add(self, s: Span) -> None:
        at = bisect_left(self.begins, s[0])
        self.begins.insert(at, s[0])
        self.ends.insert(at, s[1])


def find(text: str, trees: Boosted, limits: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, both by start and kind."""
    base = base_spans(text)
    taken = _Taken(base)
    new = [c for c in candidates(text) if not taken.meets(c)]
    if not new:
        return base, base
    p = trees.probability(np.array([features(text, c) for c in new]))
    accepted: list[Span] = []
    for i in sorted(range(len(new)), key=lambda i: (-p[i], new[i])):
        s = new[i]
        if p[i] >= limits[s[2]] and not taken.meets(s):
            accepted.append(s)
            taken.add(s)
    return base, sorted(base + accepted, key=lambda s: (s[0], ALL.index(s[2])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def pii_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added, n_secret) per row.

    Positions count code points, the end is exclusive.  The four counts and the
    digest are those of the base spans; ``n_spans`` counts all, ``n_added``
    those that the trees add, ``n_secret`` the tokens and keys among these.  A
    null or empty text has no spans; its digest is that of the empty string.
    Texts are taken whole and each by itself: repeated rows give repeated rows.
    Of candidates with equal scores the one that starts first is kept.
    """
    trees, limits = model()

    def work(texts: list[str | None]) -> dict:
        found = [find(t or "", trees, limits) for t in texts]
        made: dict = {f"n_{k}": [sum(s[2] == k for s in b) for b, _ in found] for k in KINDS}
        made["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
        made["spans"] = [listed(a) for _, a in found]
        made["n_spans"] = [len(a) for _, a in found]
        made["n_added"] = [len(a) - len(b) for b, a in found]
        made["n_secret"] = [sum(s[2] == "secret" for s in a) for _, a in found]
        return made

    return map_texts(df, [key], text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long, n_secret long", work)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"<{k}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(df: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """``df`` with personal data replaced in its texts; ``size`` (if there is such a column) follows.  Null stays null."""
    trees, limits = model()

    def work(texts: list[str | None]) -> dict:
        new = [None if t is None else redacted(t, find(t, trees, limits)[1]) for t in texts]
        return {text: new, size: [None if t is None else len(t) for t in new]}

    return map_rows(df, text, work)
