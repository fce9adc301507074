"""Chunks of long texts as column expressions: fixed windows, packed sentences, packed tokens.

Every strategy first finds where chunks begin and end, by a fold over lengths
only, and then takes the texts by position.  Nothing leaves the JVM, and short
texts are not looked at beyond their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SIZE, OVERLAP = 8000, 200
#: White space as Python's ``strip`` and ``\\s`` know it, for sets of characters and classes.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
SENTENCE_ENDS = {"en": f"[.!?]+[{SPACE}]+", "ja": f"[。！？]+[{SPACE}]*"}
JAPANESE = "[぀-ゟ゠-ヿ一-龯]"
TOKEN = f"[一-龯]+|[぀-ゟ]+|[゠-ヿ]+|[A-Za-z0-9]+|[^{SPACE}]"
SPANS = "array<struct<a:int,b:int>>"
CHUNKS = "array<struct<content:string,index:int,start:int,end:int,language:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _slice(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a + 1, b - a)


def _numbered(texts: Column) -> Column:
    """Chunks without the blank ones, numbered from 0: (content, start, end, language) structs in."""
    full = F.filter(texts, lambda c: c["content"] != "")
    return F.transform(full, lambda c, i: F.struct(c["content"], i.alias("index"), c["start"], c["end"], c["language"])).cast(CHUNKS)


def fixed_spans(text: Column, size: int, overlap: int) -> Column:
    """(a, b) of windows of ``size`` that end after the last blank of their final tenth; the next begins ``overlap`` before the end.

    A window moves on by one place at least, so the fold has as many turns as
    windows that all end at the first place of their tenth.
    """
    n, tenth = F.length(text), size // 10
    turns = F.ceil(n / max(1, size - tenth + 1 - overlap)).cast("int")

    def turn(s: Column, _: Column) -> Column:
        a, most = s["a"], s["a"] + size
        # the last blank is the first one from behind
        back = F.instr(F.reverse(_slice(text, most - tenth, most)), " ") if tenth else F.lit(0)
        b = F.when(most >= n, n).when(back > 0, most - back + 1).otherwise(most)
        return F.when(a >= n, s).otherwise(
            _let(b, lambda b: F.struct(F.when(b >= n, n).otherwise(F.greatest(a + 1, b - overlap)).alias("a"), F.concat(s["done"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("done")))
        )

    start = F.struct(F.lit(0).alias("a"), F.array().cast(SPANS).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), start, turn, lambda s: s["done"])


def packed_spans(lengths: Column, size: int, gap: int, back: Callable[[Column, Column], Column]) -> Column:
    """(a, b) of chunks in parts of these lengths, put together with ``gap`` characters between them.

    A part goes to the open chunk if that stays within ``size``; else the chunk
    ends before it and the next one begins at ``back`` of its two ends.
    """

    def part(s: Column, n: Column) -> Column:
        stop = s["b"] + F.when(s["b"] > 0, gap).otherwise(0) + n
        full = (s["b"] > s["a"]) & (stop - s["a"] > size)
        ended = F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))
        return F.struct(F.when(full, back(s["a"], s["b"])).otherwise(s["a"]).alias("a"), stop.alias("b"), F.when(full, F.concat(s["done"], ended)).otherwise(s["done"]).alias("done"))

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast(SPANS).alias("done"))
    last = lambda s: F.concat(s["done"], F.array(F.struct(s["a"], s["b"])))
    return F.aggregate(lengths, start, part, lambda s: F.when(s["b"] > 0, last(s)).otherwise(s["done"]))


def fixed(text: Column, size: int = MAX_SIZE, overlap: int = OVERLAP) -> Column:
    """Fixed windows, trimmed; positions are those before trimming, and blank ones are left out."""
    rows = F.transform(
        fixed_spans(text, size, overlap), lambda s: F.struct(F.btrim(_slice(text, s["a"], s["b"]), F.lit(SPACE)).alias("content"), s["a"].alias("start"), s["b"].alias("end"), F.lit("unknown").alias("language"))
    )
    return _numbered(rows)


def is_japanese(text: Column) -> Column:
    """Whether over a tenth of the characters are kana or kanji."""
    n = F.length(text)
    return n - F.length(F.regexp_replace(text, JAPANESE, "")) > n * F.lit(0.1)


def by_sentence(text: Column, size: int = MAX_SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences without their ends, one blank apart, as many as fit; a chunk begins with the last ``overlap`` characters of the one before.

    Every chunk is a stretch of all sentences joined.  Without overlap the
    next chunk holds the whole one before, and all starts are the place of the
    first sentence, as the rules are written.
    """

    def cut(lang: str) -> Column:
        pieces = F.filter(F.transform(F.split(text, SENTENCE_ENDS[lang]), lambda p: F.btrim(p, F.lit(SPACE))), lambda p: p != "")
        keep = (lambda a, b: F.greatest(a, b - overlap)) if overlap else (lambda a, b: a)

        def chunk(p: Column) -> Column:
            at = F.instr(text, F.get(p, F.lit(0))) - 1
            rows = lambda joined: F.transform(
                packed_spans(F.transform(p, F.length), size, 1, keep),
                lambda s: F.struct(F.btrim(_slice(joined, s["a"], s["b"]), F.lit(SPACE)).alias("content"), at.alias("start"), (at + s["b"] - s["a"]).alias("end"), F.lit(lang).alias("language")),
            )
            return _let(F.array_join(p, " "), rows)

        return _numbered(_let(pieces, chunk))

    return F.when(is_japanese(text), cut("ja")).otherwise(cut("en"))


def bigrams(text: Column) -> Column:
    """Built-in tokens for Japanese: runs of one class of characters, of kana and kanji in twos where longer than three."""
    runs = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    twos = lambda r: F.transform(F.sequence(F.lit(1), F.length(r), F.lit(2)), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{JAPANESE}") & (F.length(r) > 3), twos(r)).otherwise(F.array(r))))


def by_token(text: Column, size: int = MAX_SIZE, tokenize: Callable[[Column], Column] = bigrams) -> Column:
    """Tokens, each with a blank after it, as many as fit; no overlap, and every start is 0."""

    def chunk(tokens: Column) -> Column:
        rows = lambda joined: F.transform(
            packed_spans(F.transform(tokens, lambda t: F.length(t) + 1), size, 0, lambda a, b: b),
            lambda s: F.struct(F.btrim(_slice(joined, s["a"], s["b"]), F.lit(SPACE)).alias("content"), F.lit(0).alias("start"), (s["b"] - s["a"]).alias("end"), F.lit("ja").alias("language")),
        )
        return _let(F.concat(F.array_join(tokens, " "), F.lit(" ")), rows)

    return _numbered(_let(tokenize(text), chunk))


def semantic(text: Column, size: int = MAX_SIZE, overlap: int = OVERLAP, tokenize: Callable[[Column], Column] = bigrams) -> Column:
    """Japanese by tokens, everything else by sentences."""
    return F.when(is_japanese(text), by_token(text, size, tokenize)).otherwise(by_sentence(text, size, overlap))


STRATEGIES: dict[str, Callable[..., Column]] = {"fixed": fixed, "sentence": by_sentence, "semantic": semantic}


def chunks(text: Column, strategy: str = "semantic", size: int = MAX_SIZE, overlap: int = OVERLAP, enabled: bool = True) -> Column:
    """Array of chunks; a short text (or any, if not enabled) is one chunk as it is.  Unknown strategies mean ``semantic``."""
    whole = F.array(F.struct(text.alias("content"), F.lit(0).alias("index"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("unknown").alias("language"))).cast(CHUNKS)
    return F.when(F.length(text) > size, STRATEGIES.get(strategy, semantic)(text, size, overlap)).otherwise(whole) if enabled else whole


def child_documents(docs: DataFrame, key: str, title: str, text: str, lang: str, **how) -> DataFrame:
    """One document per chunk of long texts: id, numbered title, chunk's language unless unknown, its length."""
    rows = docs.select(F.col(key), F.col(title).alias("t"), F.col(lang).alias("l"), F.posexplode(chunks(F.col(text), **how)).alias("i", "c"))
    many = F.col("c.language") != "unknown"
    return rows.select(
        F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("i").cast("string")).alias("id"),
        F.concat("t", F.lit(" (Part "), (F.col("i") + 1).cast("string"), F.lit(")")).alias("title"),
        F.col("c.content").alias("content"),
        F.when(many, F.col("c.language")).otherwise(F.col("l")).alias("language"),
        F.length("c.content").alias("content_length"),
    )
