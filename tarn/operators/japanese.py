"""Japanese features over token structs; the tokenizer is a plug-in.

Tokens carry named fields (surface, base, pos, detail1, detail2), so scores do
not depend on a dictionary's layout.  Without a dictionary the built-in
segmenter gives runs of one character class as nouns or symbols.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed values of the scoring rules.
POS_SCORES = {"名詞": 3.0, "動詞": 2.0, "形容詞": 2.0, "副詞": 1.5, "連体詞": 1.0}
CONTENT_POS = ("名詞", "動詞", "形容詞", "副詞", "連体詞", "感動詞")
STOP_POS = ("助詞", "助動詞", "記号", "フィラー")
STOP_DETAILS = ("代名詞", "非自立", "数")
TOKEN = StructType([StructField(n, StringType()) for n in ("surface", "base", "pos", "detail1", "detail2")])
Tokenizer = Callable[[str], list[tuple]]


def segment(text: str) -> list[tuple]:
    """Runs of one class: kanji, katakana and Latin runs are nouns, hiragana particles, the rest symbols."""
    out = []
    for run in re.findall("[一-龯]+|[゠-ヿ]+|[぀-ゟ]+|[A-Za-z]+|[0-9]+|[^\\s]", text):
        if re.match("[一-龯゠-ヿA-Za-z]", run):
            out.append((run, run, "名詞", "一般", ""))
        elif re.match("[0-9]", run):
            out.append((run, run, "名詞", "数", ""))
        elif re.match("[぀-ゟ]", run):
            out.append((run, run, "助詞", "", ""))
        else:
            out.append((run, run, "記号", "", ""))
    return out


def analyze(text: Column, tokenizer: Tokenizer = segment) -> Column:
    @F.pandas_udf(ArrayType(TOKEN))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else tokenizer(t))

    return run(text)


def is_content(t: Column) -> Column:
    return t["pos"].isin(*CONTENT_POS)


def is_stop(t: Column) -> Column:
    return t["pos"].isin(*STOP_POS) | t["detail1"].isin(*STOP_DETAILS) | (F.length(t["surface"]) < 2)


def score(t: Column) -> Column:
    base = F.lit(0.0)
    for pos, points in POS_SCORES.items():
        base = F.when(t["pos"] == pos, points).otherwise(base)
    noun = t["pos"] == "名詞"
    return (
        base
        + F.when(noun & t["detail1"].isin("固有", "一般"), 1.0).otherwise(0.0)
        + F.when(noun & (t["detail1"] == "固有") & t["detail2"].isin("人名", "地域", "組織"), 2.0).otherwise(0.0)
        + F.when(F.length(t["surface"]) >= 4, 0.5).otherwise(0.0)
        + F.when(t["surface"].rlike("[一-龯]"), 0.5).otherwise(0.0)
    )


def keywords(tokens: Column, most: int) -> Column:
    """Base forms by summed score, ties in order of first appearance."""
    good = F.transform(F.filter(tokens, lambda t: is_content(t) & ~is_stop(t)), lambda t: F.struct(t["base"].alias("b"), score(t).alias("s")))

    def best(good: Column) -> Column:
        total = lambda b: F.aggregate(good, F.lit(0.0), lambda s, t: s + F.when(t["b"].eqNullSafe(b), t["s"]).otherwise(0.0))
        scored = F.transform(F.array_distinct(F.transform(good, lambda t: t["b"])), lambda b, i: F.struct((-total(b)).alias("s"), i.alias("i"), b.alias("b")))
        return F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x["b"])

    # an array of one, so that the tokens are scored once and not for each base form
    return F.transform(F.array(good), best)[0]


def normalized(tokens: Column) -> Column:
    return F.array_join(F.transform(F.filter(tokens, lambda t: ~is_stop(t)), lambda t: t["base"]), " ")


def noun_phrases(tokens: Column) -> Column:
    """Runs of two nouns or more, joined, of three characters or more."""
    start = F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    ended = lambda s: F.when((s["n"] >= 2) & (F.length(s["run"]) >= 3), F.array_append(s["out"], s["run"])).otherwise(s["out"])
    step = lambda s, t: F.when(t["pos"] == "名詞", F.struct(F.concat(s["run"], t["surface"]).alias("run"), (s["n"] + 1).alias("n"), s["out"].alias("out"))).otherwise(F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), ended(s).alias("out")))
    return F.aggregate(tokens, start, step, ended)


def fallback_keywords(text: Column, most: int, mode: str = "intended") -> Column:
    """Runs of Japanese characters (two or more) and Latin words (three or more), sorted.

    As written the class lists the letters of its names instead of the kana.
    """
    cls = "[ひらがなカタカナ一-龯]" if mode == "faithful" else "[぀-ゟ゠-ヿ一-龯]"
    ja = F.filter(F.regexp_extract_all(text, F.lit(f"({cls}+)")), lambda w: F.length(w) >= 2)
    en = F.transform(F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z]+)")), lambda w: F.length(w) >= 3), lambda w: F.lower(w))
    return F.slice(F.array_sort(F.array_distinct(F.concat(ja, en))), 1, most)
