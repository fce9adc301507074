"""Media columns: bytes kept as lossless WebP images, read back as pixel arrays.

A payload of 64 * n bytes is n rows of 16 RGBA pixels.  An image has at most
``ROWS`` rows; a longer payload becomes several files one after the other,
each of which names its own length.  Images of many payloads are written and
read together (``webp_batch``); other writers' files may have any size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import lean, map_texts, slices, small_batches
from tarn.llm.webp import riff
from tarn.llm.webp_batch import chunks_of, decode, encode

ROW_BYTES = 64
ROWS = 64
#: Bytes worked on together; small images want many at once.
BUDGET = 2_500_000
DIGESTS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def to_media(raws: list[bytes]) -> list[bytes]:
    """The stored form of each payload: zeros up to a positive multiple of 64, then WebP files."""
    images, per = [], []
    for raw in raws:
        rows = max(1, -(-len(raw) // ROW_BYTES))
        pixels = np.frombuffer(raw.ljust(rows * ROW_BYTES, b"\0"), dtype=np.uint8).reshape(rows, ROW_BYTES // 4, 4)
        images += [pixels[k : k + ROWS] for k in range(0, rows, ROWS)]
        per.append(-(-rows // ROWS))
    made = iter(encode(images))
    return [b"".join(riff(next(made)) for _ in range(n)) for n in per]


def from_media(media: list[bytes]) -> list[np.ndarray]:
    """The pixels of each value: all its files, one below the other."""
    files = [chunks_of(m) for m in media]
    pixels = iter(decode([c for f in files for c in f]))
    out = []
    for f in files:
        parts = [next(pixels) for _ in f]
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out


def feature(pixels: np.ndarray) -> str:
    """64 bits in hex: which of the 64 column means lie above their mean."""
    sums = pixels.reshape(len(pixels), -1).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * len(sums) > sums.sum()).tobytes().hex()


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text's UTF-8 bytes as WebP.  Null counts as empty: one row of zeros.

    A text of any length is stored whole, in several files of one value where
    it is long.  Each row is stored by itself: repeated rows and equal texts
    give equal values, and of transforms that tie the first is taken.
    """

    def work(texts: list[str | None]) -> dict:
        raws = [(t or "").encode("utf-8") for t in texts]
        return {"n_bytes": [len(r) for r in raws], "media": to_media(raws)}

    return map_texts(df, [key], text, "n_bytes long, media binary", work, BUDGET)


def decode_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, width, height, pixels): the pixel array of every stored image, row by row as RGBA bytes.

    A null media value gives null columns; damaged bytes raise an error.
    """
    small_batches(df.sparkSession)
    schema = df.select(F.col(f"`{key}`")).schema.add("width", "integer").add("height", "integer").add("pixels", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__media", BUDGET):
                stored = part.column("__media").to_pylist()
                there = iter(from_media([m for m in stored if m is not None]))
                found = [None if m is None else next(there) for m in stored]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array([None if p is None else p.shape[1] for p in found], pa.int32()),
                        pa.array([None if p is None else p.shape[0] for p in found], pa.int32()),
                        pa.array([None if p is None else p.tobytes() for p in found], pa.binary()),
                    ],
                    names=[key, "width", "height", "pixels"],
                )

    return df.select(F.col(f"`{key}`"), F.col(f"`{media}`").alias("__media")).mapInArrow(lean(run), schema)


def media_digests(df: DataFrame, key: str = "doc_id", size: str = "n_bytes", media: str = "media") -> DataFrame:
    """Reads the stored bytes of ``encode_media`` back and digests what came out.

    A row for each row, of any length; equal bytes give equal digests.  A null
    or damaged value is an error.
    """
    from pyspark.sql.types import StructType

    schema = StructType([*df.select(F.col(f"`{key}`")).schema.fields, *StructType.fromDDL(DIGESTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__media", BUDGET):
                rows = {n: [] for n in schema.names[2:]}
                stored = part.column("__media").to_pylist()
                for m, pixels in zip(stored, from_media(stored), strict=True):
                    payload = pixels.tobytes()
                    for n, v in zip(
                        rows,
                        (
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-ROW_BYTES:]),
                            len(m),
                            hashlib.sha256(m).hexdigest(),
                            feature(pixels),
                        ),
                        strict=True,
                    ):
                        rows[n].append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column("__size"), *map(pa.array, rows.values())], names=schema.names
                )

    return df.select(
        F.col(f"`{key}`"), F.col(f"`{size}`").alias("__size"), F.col(f"`{media}`").alias("__media")
    ).mapInArrow(lean(run), schema)
