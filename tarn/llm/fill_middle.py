"""Fill-in-middle transformation: two cuts in a text by unit ranks, found by overlapping chunks.

Units (code points, words, lines) begin where a predicate on two neighbouring
bytes holds, so chunks that overlap by one byte can be counted apart from each
other, all at once.  Prefix sums over the chunks' counts say which chunk owns
the unit of a given rank; only that chunk is looked through again for the
unit's place.  A text is then cut at two ranks into prefix, middle and suffix,
and put together with markers in one of two orders.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many put the suffix first.
PLAIN_PERCENT = 10
SPM_PERCENT = 20
SEED = 1
#: Bytes of a chunk without its overlap.
CHUNK = 4096

SCHEMA = "n long, form string, prefix_units long, middle_units long, output string"


def _code_points(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return byte & 0xC0 != 0x80


def _blank(byte: np.ndarray) -> np.ndarray:
    return (byte == 0x20) | (byte - np.uint8(9) < 5)


def _words(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _blank(before) & ~_blank(byte)


def _lines(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return before == 0x0A


#: Whether a unit begins at a byte, by it and the byte before; before a text's first byte stands a line feed.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"chars": _code_points, "words": _words, "lines": _lines}


class Chunks:
    """The units of many texts: counts by chunk, and places by rank.

    ``data`` holds the texts' UTF-8 bytes one after the other, ``ends`` where
    each text ends.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str = "chars", chunk: int = CHUNK):
        self.begins_unit = UNITS[unit]
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.ends = ends.astype(np.int64)
        # a line feed before every text is the overlap of its first chunk
        self.shift = np.arange(1, len(ends) + 1)
        self.data = np.insert(data, starts, 0x0A) if len(ends) else data
        per = -(-(self.ends - starts) // chunk)
        self.first_chunk = np.cumsum(per) - per
        own = np.repeat(np.arange(len(ends)), per)
        number = np.arange(len(own)) - self.first_chunk[own]
        self.begin = (starts + self.shift)[own] + number * chunk
        self.stop = np.minimum(self.begin + chunk, (self.ends + self.shift)[own])
        counts = np.zeros(len(own), dtype=np.int64)
        if len(own):
            # every chunk with the byte before it; between texts lies one byte that is in no chunk
            marks = self.begins_unit(self.data[:-1], self.data[1:])
            edges = np.stack([self.begin, self.stop], axis=1).ravel() - 1
            sums = np.concatenate(([0], np.cumsum(marks)))
            counts = sums[edges[1::2]] - sums[edges[::2]]
        self.sums = np.concatenate(([0], np.cumsum(counts)))
        self.units = self.sums[self.first_chunk + per] - self.sums[self.first_chunk]

    def place(self, text: int, rank: int) -> int:
        """Byte of the text at which its unit of this rank begins, or the text's length."""
        base = self.ends[text - 1] if text else 0
        if rank >= self.units[text]:
            return int(self.ends[text] - base)
        wanted = self.sums[self.first_chunk[text]] + rank
        chunk = int(np.searchsorted(self.sums, wanted, side="right")) - 1
        a, b = self.begin[chunk], self.stop[chunk]
        marks = self.begins_unit(self.data[a - 1 : b - 1], self.data[a:b])
        at = np.flatnonzero(marks)[wanted - self.sums[chunk]]
        return int(a + at - self.shift[text] - base)


def drawn(key: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the key; a null key counts as the empty string."""
    told = "" if key is None else str(key)
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{told}".encode()).digest()[:16])


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "chars", seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """(key, n, form, prefix_units, middle_units, output) per row of ``df``.

    ``n`` is the number of units.  Cuts and form follow from the seed and the
    key alone, so equal rows are cut alike and reruns agree.  A null or empty
    text and one that holds a marker stay ``plain``, with null cuts; their
    output is the text (empty for null).  With words or lines what precedes
    the first unit goes to the prefix.  Texts of any length are taken whole.
    """
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def work(keys: list, texts: list[str | None]) -> dict:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        units = Chunks(np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum([len(r) for r in raws]), unit, chunk)
        forms, prefixes, middles, outputs = [], [], [], []
        for d, (k, raw) in enumerate(zip(keys, raws, strict=True)):
            h1, h2, h3, h4 = drawn(k, seed)
            if not raw or h3 % 100 >= 100 - PLAIN_PERCENT or any(m in raw for m in markers):
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
                outputs.append(raw)
                continue
            form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
            n = int(units.units[d])
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = units.place(d, low), units.place(d, high)
            if not low and unit != "chars":
                a = 0
            forms.append(form)
            prefixes.append(low)
            middles.append(high - low)
            outputs.append(arranged(form, raw[:a], raw[a:b], raw[b:]))
        return {"n": units.units, "form": forms, "prefix_units": prefixes, "middle_units": middles, "output": pa.array(outputs, pa.binary()).cast(pa.string())}

    return map_texts(df, [key], text, SCHEMA, work, with_key=key)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts, by the markers, in their first order.

    No marker is in the text, and none can arise where parts meet, since no
    end of a marker is a beginning of one.
    """
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fim_digests(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``fill_in_middle`` by code points."""
    return made.select(
        F.col(f"`{key}`"),
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
