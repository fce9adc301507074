"""Periodic runs of words: bit-parallel lags over big integers.

The words of a text get numbers; bit b of all numbers is one big integer, a
*plane*, with a bit for each word.  For a lag q every plane is XORed with
itself shifted by q, and the results are ORed: a zero bit at i says that the
words i and i+q are equal.  A run of period q is a stretch of such zeros, q
shorter than the run.  ANDing the complement with itself, shifted by 1, 2, 4,
..., leaves a bit for each start of a stretch that is long enough, so that one
test of the whole number for zero ends most lags.

The low planes alone decide most lags: with ``HEAD_PLANES`` of them the
complement holds every true stretch and hardly another one, and the other
planes are only shifted for a lag that is still open.  In a very long text
(``SIEVE_WORDS``) a lag over ``SIEVE_LAG`` is first asked at a few places: a
stretch of q holds at least four neighbouring multiples of q // 4, so a lag
without four such equal pairs in a row has no run.  All of this only saves
work; no lag and no text is left out.
"""

from __future__ import annotations

from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import WORD, map_texts

LEAST_WORDS = 12
LEAST_PERIODS = 2
HEAD_PLANES = 4
GROUP_WORDS = 16_384
SIEVE_WORDS = 30_000
SIEVE_LAG = 32

SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words, from 0 in order of first places."""
    order: dict[bytes, int] = {}
    fresh = count()
    first = np.fromiter(map(order.setdefault, words, fresh), dtype=np.int64, count=len(words))
    number = np.zeros(len(words), dtype=np.int64)
    number[first[first == np.arange(len(words))]] = np.arange(len(order))
    return number[first]


def planes(ids: np.ndarray) -> list[int]:
    """The bits of all numbers as big integers, lowest plane first; bit i belongs to word i."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(width)]


def isolated(same: int, least: int) -> int:
    """The bits of ``same`` at which a stretch of ``least`` ones begins."""
    held = 1
    while same and held < least:
        step = min(held, least - held)
        same &= same >> step
        held += step
    return same


def stretches(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places of the stretches of ones among the n low bits."""
    flat = np.unpackbits(np.frombuffer(bits.to_bytes(-(-n // 8), "little"), dtype=np.uint8), bitorder="little")
    edge = np.diff(np.concatenate(([0], flat, [0])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def worth(ids: np.ndarray, q: int, long_runs: list[tuple[int, int, int]]) -> bool:
    """Whether lag q can have a run that none of ``long_runs`` explains.

    Four equal pairs in a row inside a run whose period divides q belong to
    that run again: an overlap of q plus that period or more has both periods.
    """
    t = q // 4
    at = ids[::t]
    far = ids[q::t]
    equal = at[: len(far)] == far
    if len(equal) < 4:
        return False
    rows = np.flatnonzero(equal[:-3] & equal[1:-2] & equal[2:-1] & equal[3:]) * t
    for start, length, period in long_runs:
        if not len(rows):
            return False
        if q % period == 0:
            rows = rows[(rows < start) | (rows + 3 * t + q >= start + length)]
    return len(rows) > 0


def runs_of(ids: np.ndarray, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by period.

    A run is a longest stretch of smallest period q with ``LEAST_WORDS`` words
    and ``LEAST_PERIODS`` periods or more.  Lags go up, so a stretch that a
    smaller period has already is a multiple of it and no run of its own.

    ``ids`` may hold several texts, one after the other, that end at ``ends``:
    the bits of a lag that reach over a text's end are masked.
    """
    n = len(ids)
    ends = np.array([n]) if ends is None else ends
    longest = int(np.diff(ends, prepend=0).max()) if len(ends) else 0
    if longest < LEAST_WORDS:
        return []
    every = planes(ids)
    head, tail = every[:HEAD_PLANES], every[HEAD_PLANES:]
    last = np.zeros(n, dtype=np.uint8)
    last[ends - 1] = 1
    over = int.from_bytes(np.packbits(last, bitorder="little").tobytes(), "little")
    inside = (1 << n) - 1
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    sieved = longest == n > SIEVE_WORDS
    long_runs: list[tuple[int, int, int]] = []
    for q in range(1, longest // LEAST_PERIODS + 1):
        least = max((LEAST_PERIODS - 1) * q, LEAST_WORDS - q)
        # a bit goes when the word q places on is the first of another text
        inside = (inside | over) ^ over if q == 1 else inside & ~(over >> q - 1)
        if sieved and q > SIEVE_LAG:
            long_runs = [r for r in long_runs if r[1] >= LEAST_PERIODS * q]
            if not worth(ids, q, long_runs):
                continue
        differ = 0
        for p in head:
            differ |= p ^ p >> q
        starts = isolated(inside & ~differ, least)
        if not starts:
            continue
        if tail:
            for p in tail:
                differ |= p ^ p >> q
            starts = isolated(inside & ~differ, least)
            if not starts:
                continue
        for a, b in zip(*(x.tolist() for x in stretches(starts, n)), strict=True):
            length = b - a + least + q
            if (a, length) not in known:
                known.add((a, length))
                found.append((a, length, q))
                if sieved and length >= LEAST_PERIODS * SIEVE_LAG:
                    long_runs.append((a, length, q))
    return found


def runs_of_each(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """``runs_of`` for each text, by start, then period.

    Texts of like lengths share big integers up to ``GROUP_WORDS`` bits: an
    operation on a few hundred bits costs as much as one on some thousands.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    group: list[int] = []
    words = 0

    def close() -> None:
        if group:
            ends = np.cumsum([len(texts[d]) for d in group])
            for start, length, period in sorted((a, length, q) for a, length, q in runs_of(np.concatenate([texts[d] for d in group]), ends)):
                at = int(np.searchsorted(ends, start, side="right"))
                out[group[at]].append((start - (int(ends[at - 1]) if at else 0), length, period))
            group.clear()

    for d in sorted((d for d, ids in enumerate(texts) if len(ids) >= LEAST_WORDS), key=lambda d: len(texts[d])):
        if words + len(texts[d]) > GROUP_WORDS:
            close()
            words = 0
        group.append(d)
        words += len(texts[d])
    close()
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def measure(texts: list[str | None]) -> dict:
    """The columns of SCHEMA for a list of texts."""
    words_of = [(text or "").encode("utf-8", "surrogatepass").split() for text in texts]
    runs_by_text = runs_of_each([numbered(words) for words in words_of])
    collapsed = []
    for words, runs in zip(words_of, runs_by_text, strict=True):
        stay = compress(words, kept_words(len(words), runs).tolist()) if runs else words
        collapsed.append(b" ".join(stay))
    flat = [r for runs in runs_by_text for r in runs]
    columns = np.array(flat, dtype=np.int64).reshape(-1, 3).T
    structs = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
    ends = np.cumsum([0, *map(len, runs_by_text)]).astype(np.int32)
    return {"n_words": list(map(len, words_of)), "runs": pa.ListArray.from_arrays(pa.array(ends), structs), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) per row of ``df``.

    ``runs`` lists (start, length, period) by start, then period; ``collapsed``
    is the text's words joined by one blank without those that some run holds
    after its first period.  Words are longest stretches without ASCII white
    space.  A null or empty text has no words, no runs and an empty
    ``collapsed``.  A text is only compared with itself, whole at any length:
    repeated rows, ties and null keys need nothing special.
    """
    return map_texts(df, [key], text, SCHEMA, measure)


def planted(df: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 10) -> DataFrame:
    """(key, text): one text in ``one_in`` gets a periodic tail, the others stay as they are.

    With h the crc32 of the key in decimal and g = h div 10, a text of n words
    with h mod ``one_in`` = 0 has from word a = g mod n on its words a to
    a + p - 1 again and again, p = 1 + (n - a) div (3 + g mod 8).  Null keys
    and texts without words get none.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    body = F.col(f"`{text}`").cast("string")
    words = F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1))
    chosen = df.select(F.col(f"`{key}`").alias("k"), body.alias("t"), h.alias("h"), F.when(h % one_in == 0, words).alias("w"))
    n = F.size("w")
    g = F.expr("h div 10")
    sized = chosen.withColumns({"a": F.when(n > 0, (g % n).cast("int")), "n": n})
    sized = sized.withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))

    def word(j: Column) -> Column:
        return F.get("w", F.col("a") + j % F.col("p"))

    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), word)
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return sized.select(F.col("k").alias(key), F.when(F.col("p").isNotNull(), made).otherwise(F.col("t")).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``periodic_runs``.

    The four figures are those of the longest run, of equal ones the first and
    of the least period; without runs they are null.
    """
    rank = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(rank)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat_ws("\n", lines, F.array(F.lit("")))
    return found.select(F.col(f"`{key}`"), F.size("runs").cast("long").alias("n_runs"), best.alias("b"), listed.alias("r"), "collapsed").select(
        F.col(f"`{key}`"),
        "n_runs",
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        F.sha2("r", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
