"""Quality rules: repeated passages by a suffix array over each text's words.

Words of many texts are ranked together.  Word ids are unique to a text, so two
suffixes of different texts never share a prefix and one vectorised prefix
doubling serves the whole slice.  The ranks kept of every doubling give the
longest common prefix of neighbours in suffix order; from those follow, for
every position, the longest run that occurs again in the same text.  Runs that
cannot be extended to the left are the maximal repeats; the union of their
spans is the covered part.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.common import SPACES, map_rows, map_texts

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Verdict of the method beyond the base rules: most of a text's code points in words that repeats may cover
#: (the usual limit for repeated five-word runs), and the most words of one repeat.
MAX_COVERED_CHARS = 0.15
MAX_LONGEST_WORDS = 50
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, longest_repeat long, n_maximal_repeats long, covered_chars double"
)


def suffix_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run starting there that also starts elsewhere.

    ``ids`` are word ids; equal ids only within one text.
    """
    n = len(ids)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    head = np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1]))
    starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = starts
    levels = [rank]
    # sorted positions whose group still has several members
    tied = ~head
    tied[:-1] |= ~head[1:]
    active = np.flatnonzero(tied)
    sa = order
    step = 1
    while len(active):
        pos = sa[active]
        nxt = pos + step
        second = np.where(nxt < n, levels[-1][np.minimum(nxt, n - 1)] + 1, 0)
        first = levels[-1][pos]
        by = np.argsort(first * (n + 1) + second, kind="stable")
        pos, first, second = pos[by], first[by], second[by]
        sa[active] = pos
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        at = np.maximum.accumulate(np.where(fresh, active, 0))
        rank = levels[-1].copy()
        rank[pos] = at
        levels.append(rank)
        keep = ~fresh
        keep[:-1] |= ~fresh[1:]
        active = active[keep]
        step *= 2
    # longest common prefix of suffix-array neighbours by descending levels
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    common = np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < n) & (y < n)
        same = np.zeros(len(near), dtype=bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        common[same] += 1 << k
    # a and b each hold a position once
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def repeat_spans(longest: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Start positions of maximal repeats of ``least`` words or more.

    The run at i can be extended to the left exactly if the run at i-1 is one
    longer; such spans lie inside the extended one.
    """
    if not len(longest):
        return np.zeros(0, dtype=np.int64)
    before = np.concatenate(([0], longest[:-1]))
    before[starts[starts < len(longest)]] = 0
    return np.flatnonzero((longest >= least) & (before <= longest))


def measure(texts: list[str | None]) -> dict:
    """The columns of SCHEMA for a list of texts."""
    n_docs = len(texts)
    words_of = np.zeros(n_docs, dtype=np.int64)
    word_chars, symbols, dup_lines = [], [], []
    ids_parts: list[np.ndarray] = []
    length_parts: list[np.ndarray] = []
    base = 0
    for d, text in enumerate(texts):
        text = text or ""
        word_chars.append(len(text) - sum(map(text.count, SPACES)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
        words = text.encode("utf-8", "surrogatepass").split()
        if words:
            n = words_of[d] = len(words)
            ids_parts.append(np.fromiter(map({}.setdefault, words, count(base)), dtype=np.int64, count=n))
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
            leads = np.frombuffer(b"".join(words), dtype=np.uint8) & 0xC0 != 0x80
            length_parts.append(np.add.reduceat(leads, np.cumsum(sizes) - sizes, dtype=np.int64))
            base += n
    ids = np.concatenate(ids_parts) if ids_parts else np.zeros(0, dtype=np.int64)
    lengths = np.concatenate(length_parts) if length_parts else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(n_docs), words_of)
    starts = np.concatenate(([0], np.cumsum(words_of)[:-1])) if n_docs else np.zeros(0, dtype=np.int64)
    longest = suffix_repeats(ids)
    spans = repeat_spans(longest, starts, WINDOW)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, spans, 1)
    np.add.at(edge, spans + longest[spans], -1)
    covered = np.cumsum(edge[:-1]) > 0
    repeat_words = np.bincount(doc[covered], minlength=n_docs)
    covered_points = np.bincount(doc[covered], weights=lengths[covered], minlength=n_docs)
    all_points = np.bincount(doc, weights=lengths, minlength=n_docs)
    share = covered_points / np.maximum(all_points, 1)
    most = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(most, doc[spans], longest[spans])
    failed = (words_of < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * words_of)
    kept = ~failed & (share <= MAX_COVERED_CHARS) & (most <= MAX_LONGEST_WORDS)
    return {
        "n_words": words_of,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": kept,
        "longest_repeat": most,
        "n_maximal_repeats": np.bincount(doc[spans], minlength=n_docs),
        "covered_chars": share,
    }


def quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key, base figures, and the verdict ``kept``.

    Words are maximal runs without ASCII white space.  A null or empty text has
    no words and fails the base rule on length.  Repeated rows, ties and texts
    of any length need nothing special: a text is only compared with itself.

    Beyond the base rules the verdict is the suffix array's: a text goes if its
    repeats of ``WINDOW`` words or more cover over ``MAX_COVERED_CHARS`` of the
    code points in its words, or if one repeat is longer than
    ``MAX_LONGEST_WORDS`` words.
    """
    return map_texts(df, [key], text, SCHEMA, measure)


def quality_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns."""
    return map_rows(df, text, measure, keep=True)
