"""Language identification: every text as a mixture of languages.

Each language has a distribution over hashed letter trigrams, counted over all
labelled rows given for training.  For a text, expectation maximisation finds
the language proportions that best explain its trigram counts.  The language
set is chosen by penalised likelihood: from the mixture of all languages the
one of least share goes, the rest is fitted again, and so on down to a single
language; of all sets on the way the one of highest likelihood less a penalty
per language (half the logarithm of the text's trigrams for each free share
and each language, as in the Bayesian criterion) is taken.  A text may have
any number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import lean, map_texts, slices

CELLS = 1 << 12
SMOOTHING = 0.5
FULL_ROUNDS = 12
REFIT_ROUNDS = 8
#: A share below this counts as none.
LEAST_SHARE = 1e-6
#: Rows worked on together; bounds memory when texts are tiny.
ROWS_AT_ONCE = 2000
UNKNOWN = "und"

_tables: dict = {}


def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else 0."""
    if "letters" not in _tables:
        known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _tables["letters"] = np.where(known, np.arange(0x110000, dtype=np.uint32), 0).astype(np.uint32)
    return _tables["letters"]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, cell, count) of the trigrams with a letter in the middle, and which texts have letters."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\0\0".join(["", *lowered, ""])
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts)) + 2
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    doc = np.concatenate(([0, 0], doc))[: len(codes)]
    at = np.flatnonzero(codes[1:-1]) + 1
    with np.errstate(over="ignore"):
        mixed = codes[at - 1] * np.uint32(0x9E3779B1) ^ codes[at] * np.uint32(0x85EBCA77) ^ codes[at + 1] * np.uint32(0xC2B2AE3D)
        mixed *= np.uint32(0x27D4EB2F)
    cell = (mixed >> np.uint32(32 - 12)).astype(np.int64)
    keys = doc[at] * CELLS + cell
    n = len(texts)
    if len(keys) * 4 > n * CELLS:
        dense = np.bincount(keys, minlength=n * CELLS)
        keys = np.flatnonzero(dense)
        counts = dense[keys]
    else:
        keys, counts = np.unique(keys, return_counts=True)
    text = keys // CELLS
    has = np.zeros(n, dtype=bool)
    has[text] = True
    return text, keys % CELLS, counts, has


def gram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, cell, n) over all rows: summed within each task first, then across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "__text"):
                texts, langs = part.column("__text").to_pylist(), part.column("__lang").to_pylist()
                for k in range(0, len(texts), ROWS_AT_ONCE):
                    doc, cell, n, _ = grams(texts[k : k + ROWS_AT_ONCE])
                    names, which = np.unique(np.array(langs[k : k + ROWS_AT_ONCE], dtype=object).astype(str), return_inverse=True)
                    for i, name in enumerate(names):
                        mine = which[doc] == i
                        add = np.bincount(cell[mine], weights=n[mine], minlength=CELLS).astype(np.int64)
                        total[name] = total.get(name, 0) + add
        for name, cells in total.items():
            some = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(cells[some], pa.int64())],
                names=["lang", "cell", "n"],
            )

    rows = df.select(F.col(f"`{text}`").alias("__text"), F.col(f"`{lang}`").cast("string").alias("__lang")).where(
        "__lang is not null and __text is not null"
    )
    parts = rows.mapInArrow(lean(run), "lang string, cell int, n long")
    return parts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names in order and their trigram distributions (languages x CELLS)."""
    found = gram_counts(df, text, lang).toPandas()
    names = sorted(found["lang"].unique())
    table = np.full((max(1, len(names)), CELLS), SMOOTHING)
    for i, name in enumerate(names):
        mine = found[found["lang"] == name]
        table[i, mine["cell"]] += mine["n"]
    return names, table / table.sum(axis=1, keepdims=True)


def _climb(shares, p, counts, doc, starts, rounds):
    """EM for the shares (texts x k), given p (grams x k); returns shares and log likelihoods."""
    total = np.add.reduceat(counts, starts)
    for _ in range(rounds):
        mixed = np.einsum("ij,ij->i", shares[doc], p)
        gain = np.add.reduceat((counts / mixed)[:, None] * p, starts, axis=0)
        shares = shares * gain / total[:, None]
    mixed = np.einsum("ij,ij->i", shares[doc], p)
    return shares, np.add.reduceat(counts * np.log(mixed), starts)


def mixtures(texts: list[str | None], names: list[str], table: np.ndarray) -> dict:
    """Predicted language, its share, and the chosen set with shares, for each text.

    The prediction has the largest share in the chosen set (of equal ones the
    first by name); the score is its share in the mixture of all languages,
    which falls below 1 where others explain the text nearly as well.
    """
    pred = [UNKNOWN] * len(texts)
    score = np.zeros(len(texts))
    sets = [""] * len(texts)
    doc, cell, n, has = grams(texts)
    if not names or not len(doc):
        return {"lang_pred": pred, "score": score, "languages": sets}
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    which = doc[starts]  # texts with letters
    number = np.repeat(np.arange(len(which)), np.diff(np.append(starts, len(doc))))
    counts = n.astype(np.float64)
    p = table.T[cell]
    every, k = len(which), len(names)
    full, likely = _climb(np.full((every, k), 1 / k), p, counts, number, starts, FULL_ROUNDS)
    size = np.add.reduceat(counts, starts)
    best = np.full(every, -np.inf)
    chosen = np.zeros((every, k))
    shares = full
    while True:
        m = (shares > LEAST_SHARE).sum(axis=1)
        value = likely - 0.5 * (2 * m - 1) * np.log(np.maximum(size, 2))
        better = value > best
        best[better] = value[better]
        chosen[better] = np.where(shares[better] > LEAST_SHARE, shares[better], 0)
        if m.max() == 1:
            break
        # the least of the shares that are left goes, if it is not the last one; of equal shares the later language
        weight = np.where(shares > LEAST_SHARE, shares, np.inf)[:, ::-1]
        last = k - 1 - np.argmin(weight, axis=1)
        shares = np.where(shares > LEAST_SHARE, shares, 0)
        several = np.flatnonzero(m > 1)
        shares[several, last[several]] = 0
        shares, likely = _climb(shares / shares.sum(axis=1, keepdims=True), p, counts, number, starts, REFIT_ROUNDS if m.max() > 2 else 0)
    order = np.argsort(-chosen, axis=1, kind="stable")
    first = np.argmax(chosen, axis=1)
    for i, d in enumerate(which):
        pred[d] = names[first[i]]
        score[d] = min(1.0, max(0.0, full[i, first[i]]))
        sets[d] = ",".join(f"{names[j]}:{chosen[i, j]:.3f}" for j in order[i] if chosen[i, j] > 0)
    return {"lang_pred": pred, "score": score, "languages": sets}


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, lang_pred, score, languages) per row; texts that are null or without letters are ``und`` with score 0."""
    names, table = model

    def work(texts: list[str | None]) -> dict:
        parts = [mixtures(texts[k : k + ROWS_AT_ONCE], names, table) for k in range(0, len(texts), ROWS_AT_ONCE)] or [mixtures([], names, table)]
        return {c: [v for part in parts for v in part[c]] for c in ("lang_pred", "score", "languages")}

    return map_texts(df, list(keys), text, "lang_pred string, score double, languages string", work, budget=2_000_000)


def held_out(key: Column) -> Column:
    """Every fifth row or so, by the checksum of its key's decimal digits."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def language_id(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, languages) per row; learned from the rows that are not held out.

    A null key is not held out.  Rows with a null text or a null language teach
    nothing; with nothing learned every text is ``und``.  Repeated rows count
    as often as they come and are all answered; equal likelihoods go to the
    first language by name.  Texts are taken whole, whatever their length.
    Training brings one count per language and trigram cell to the driver.
    """
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__t"), F.col(f"`{lang}`").alias("__l"))
    model = train(rows.where(~F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False))), "__t", "__l")
    marked = rows.withColumn("held_out", F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False)))
    return predict(marked, model, (key, "held_out"), "__t")
