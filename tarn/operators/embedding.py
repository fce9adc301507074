"""Embeddings by a pluggable model over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tarn.functions.text import truncated

#: Known models and their dimensions.
DIMENSIONS = {"large": 1536, "medium": 1024, "hashed": 64}
#: Texts whose words are held at once.
ROWS_AT_ONCE = 256


def dimension(model: str) -> int:
    if model not in DIMENSIONS:
        raise ValueError(f"unsupported model {model}")
    return DIMENSIONS[model]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the texts, in order."""
    words = [(t or "").lower().split() for t in texts]
    many = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, chain.from_iterable(words))), ">u8").astype(np.uint64)
    return np.repeat(np.arange(len(words)), many), hashes


def by_words(texts: list[str | None], *models: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """The models' vectors side by side; each text is cut into words once, some texts at a time."""
    parts = [texts[k : k + ROWS_AT_ONCE] for k in range(0, max(len(texts), 1), ROWS_AT_ONCE)]
    return np.concatenate([np.hstack([m(*found, len(some)) for m in models]) for some in parts for found in [word_hashes(some)]])


def hashed(texts: list[str], dims: int = 64) -> np.ndarray:
    """Signed feature hashing of words, unit length: the deterministic local model."""
    return by_words(texts, partial(signed, dims=dims))


def signed(rows: np.ndarray, hashes: np.ndarray, texts: int, dims: int) -> np.ndarray:
    """``hashed`` of so many texts by the hashes of their words."""
    slots, signs = (hashes % np.uint64(dims)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)
    out = np.bincount(rows * dims + slots, signs, texts * dims).reshape(-1, dims).astype(np.float32)
    for x in out:
        x /= float(np.linalg.norm(x)) or 1
    return out


def embed(text: Column, model: Callable[[list[str]], np.ndarray] = hashed) -> Column:
    """Vectors of texts cut to the model's limit; blank and null texts have none."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            good = texts.map(lambda t: bool(t and t.strip()))
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if good.any():
                made = model(texts[good].tolist())
                out[good] = pd.Series(list(made), index=texts.index[good])
            yield out

    return run(truncated(text))
