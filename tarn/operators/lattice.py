"""Morphological analysis by a word lattice: all dictionary words at all places, and the path of least cost.

A dictionary is in the usual form: CSV files with surface, left and right
connection number, word cost, part of speech with its details, and the base
form; and a matrix of costs by right number of a word and left number of the
next.  What no word covers becomes an unknown word: a run of one class of
characters.  The dictionary is read by Spark, checked to be of bounded size and
broadcast; texts are analysed in Arrow batches, each by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tarn.operators.japanese import TOKEN, is_stop

#: Entries and matrix cells that may be broadcast: some hundred megabytes in a worker.
MOST_ENTRIES, MOST_CELLS = 1_000_000, 20_000_000
#: Cost of an unknown word, more for each character, and the number its connections count as.
UNKNOWN_COST, UNKNOWN_MORE, UNKNOWN_ID = 10_000, 500, 0
LONGEST_UNKNOWN = 24
CSV = "surface string, left_id int, right_id int, cost int, pos string, detail1 string, detail2 string, detail3 string, kind string, form string, base string, reading string, sound string"


def char_class(c: str) -> str:
    """The class of a character, for runs of unknown words."""
    if "぀" <= c <= "ゟ":
        return "hiragana"
    if "゠" <= c <= "ヿ" or c == "ｰ":
        return "katakana"
    if "一" <= c <= "鿿" or c == "々":
        return "kanji"
    if c.isspace():
        return "space"
    if c.isdigit():
        return "digit"
    return "letter" if c.isalpha() else "sign"


@dataclass
class Dictionary:
    """Words by surface: (left, right, cost, pos, detail1, detail2, base); and connection costs by (right, left)."""

    words: dict[str, list[tuple]]
    joins: dict[tuple[int, int], int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.words), default=0)

    def at(self, text: str, i: int) -> list[tuple[int, tuple]]:
        """(end, word) of all words that begin at a place, with an unknown one where there is none or the class asks for it."""
        found = [(j, w) for j in range(i + 1, min(len(text), i + self.longest) + 1) for w in self.words.get(text[i:j], ())]
        kind = char_class(text[i])
        if not found or kind in ("katakana", "letter", "digit"):
            j = i + 1
            while j < len(text) and j - i < LONGEST_UNKNOWN and kind != "sign" and char_class(text[j]) == kind:
                j += 1
            if not any(end == j for end, _ in found):
                pos = ("記号", "空白" if kind == "space" else "一般") if kind in ("space", "sign") else ("名詞", "数" if kind == "digit" else "一般")
                found.append((j, (UNKNOWN_ID, UNKNOWN_ID, UNKNOWN_COST + UNKNOWN_MORE * (j - i), *pos, "", text[i:j])))
        return found

    def join(self, right: int, left: int) -> int:
        return self.joins.get((right, left), 0)

    def path(self, text: str) -> tuple[int, list[tuple[int, int, tuple]]]:
        """(cost, [(start, end, word)]) of the cheapest path; of equal ones that with the longer last word, and so on back.

        Per place the best way to each right number that ends there is kept.
        """
        n = len(text)
        best: list[dict[int, tuple[int, int, int, tuple | None]]] = [{} for _ in range(n + 1)]  # right -> cost, start, right before, word
        best[0][0] = (0, 0, 0, None)
        for i in range(n):
            if not best[i]:
                continue
            for end, word in self.at(text, i):
                cost, before = min((c + self.join(r, word[0]), r) for r, (c, *_) in best[i].items())
                told = (cost + word[2], i, before, word)
                old = best[end].get(word[1])
                if old is None or told[:2] < old[:2]:
                    best[end][word[1]] = told
        total, right = min((c + self.join(r, 0), r) for r, (c, *_) in best[n].items())
        out, at = [], n
        while at:
            _, start, before, word = best[at][right]
            out.append((start, at, word))
            at, right = start, before
        return total, out[::-1]

    def tokens(self, text: str) -> list[tuple[str, str, str, str, str]]:
        """(surface, base, pos, detail1, detail2) of the words on the path, without white space."""
        return [(text[a:b], w[6] if w[6] not in ("", "*") else text[a:b], *w[3:6]) for a, b, w in self.path(text)[1] if not text[a:b].isspace()]


def read(spark: SparkSession, words: str, matrix: str | None = None, encoding: str = "UTF-8") -> Dictionary:
    """A dictionary from CSV files and a matrix file; an error for one that is too large to be sent to every worker."""
    rows = spark.read.schema(CSV).option("encoding", encoding).csv(words).where("surface is not null")
    if (n := rows.count()) > MOST_ENTRIES:
        raise ValueError(f"{n} words, more than {MOST_ENTRIES}")
    found: dict[str, list[tuple]] = {}
    for r in rows.select("surface", "left_id", "right_id", "cost", "pos", F.coalesce("detail1", F.lit("")), F.coalesce("detail2", F.lit("")), F.coalesce("base", F.lit(""))).collect():
        found.setdefault(r[0], []).append(tuple(r)[1:])
    joins: dict[tuple[int, int], int] = {}
    if matrix:
        cells = spark.read.text(matrix).select(F.split("value", r"\s+").alias("v")).where(F.size("v") == 3).selectExpr("int(v[0]) r", "int(v[1]) l", "int(v[2]) c").where("c <> 0")
        if (n := cells.count()) > MOST_CELLS:
            raise ValueError(f"{n} connections, more than {MOST_CELLS}")
        joins = {(r.r, r.l): r.c for r in cells.collect()}
    return Dictionary(found, joins)


def analyzer(spark: SparkSession, dictionary: Dictionary) -> Callable[[Column], Column]:
    """Text column -> array of tokens, by the broadcast dictionary; null has none."""
    shared = spark.sparkContext.broadcast(dictionary)

    @F.pandas_udf(ArrayType(TOKEN))
    def run(texts: pd.Series) -> pd.Series:
        d = shared.value
        return texts.map(lambda t: [] if t is None else d.tokens(t))

    return run


def terms(tokens: Column) -> Column:
    """Index terms: base forms in lower case of the words that are no particles, signs or single characters of grammar."""
    return F.transform(F.filter(tokens, lambda t: ~is_stop(t)), lambda t: F.lower(t["base"]))
