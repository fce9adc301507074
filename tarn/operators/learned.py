"""Text vectors learnt from a corpus: weighted word counts and a randomised singular value decomposition.

Words fall into a fixed number of features by a hash; a text's features are
weighted by how rare they are.  Each text is cut into words once and its counts
are kept; the leading directions of all texts' features are found by a few
passes over these: each multiplies a small set of directions by the features
and back, every task adds up its part in place, and the parts are summed by
blocks of features.  What comes to the driver has the size of the model,
whatever the number of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.embedding import ROWS_AT_ONCE, by_words, word_hashes
from tarn.sources.shared import remove, shared_folder

#: Features, directions beside the wanted ones, passes, and features of one block of a sum.
FEATURES, EXTRA, PASSES, BLOCK = 1 << 14, 64, 3, 256
SEED = 5
#: (row, feature, count or value) of texts.
Triples = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Vectors:
    """A model: ``vectors(texts)`` gives a row of unit length for each text, zero where no word is known."""

    weights: np.ndarray  # per feature
    directions: np.ndarray  # features x dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        return by_words(texts, self.of)

    def of(self, rows: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
        """The vectors of so many texts by the hashes of their words."""
        out = np.zeros((texts, self.directions.shape[1]))
        at, ids, values = weighted(*counts(rows, hashes, len(self.weights)), self.weights, texts)
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[first]] = np.add.reduceat(values[:, None] * self.directions[ids], first, axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).astype(np.float32)


def counts(rows: np.ndarray, hashes: np.ndarray, n: int) -> Triples:
    """(row, feature, count) of words, by row and feature."""
    pairs, many = np.unique(rows * n + (hashes % np.uint64(n)).astype(np.int64), return_counts=True)
    return pairs // n, pairs % n, many


def weighted(rows: np.ndarray, ids: np.ndarray, n: np.ndarray, weights: np.ndarray, texts: int) -> Triples:
    """(row, feature, value): damped counts times weights, of length one in each text; texts without weight have none."""
    values = (1 + np.log(n)) * weights[ids]
    size = np.sqrt(np.bincount(rows, values * values, texts))[rows]
    some = size > 0
    return rows[some], ids[some], values[some] / size[some]


def features(texts: list[str | None], weights: np.ndarray) -> Triples:
    """(row, feature, value) of texts."""
    return weighted(*counts(*word_hashes(texts), len(weights)), weights, len(texts))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def counted(df: DataFrame, text: str, n: int = FEATURES) -> DataFrame:
    """(ids, n) per text: its features in order and their counts, as bytes of unsigned numbers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            rows, ids, many = counts(*word_hashes(batch.column(0).to_pylist()), n)
            ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(batch)))).astype(np.int32) * 4
            # one buffer of bytes and where each text's begin
            held = [pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(x.astype("<u4"))]) for x in (ids, many)]
            yield pa.RecordBatch.from_arrays(held, names=["ids", "n"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "ids binary, n binary")


def _triples(batch: pa.RecordBatch) -> Triples:
    """What ``counted`` holds of some texts."""
    ids, many = (x.to_pylist() for x in batch.columns)
    rows = np.repeat(np.arange(len(batch)), [len(x) // 4 for x in ids])
    return rows, *(np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (ids, many))


def document_weights(held: DataFrame, n: int = FEATURES) -> np.ndarray:
    """log((1 + texts) / (1 + texts with the feature)) per feature; features of no text have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros(n, dtype=np.int64), 0
        for batch in _batches(batches):
            total += np.bincount(_triples(batch)[1], minlength=n)
            many += len(batch)
        some = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.append(total[some[:-1]], many))], names=["feature", "n"])

    found = held.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    having = {r.feature: r.n for r in found}
    many = having.pop(-1, 0)
    out = np.zeros(n)
    for f, c in having.items():
        out[f] = np.log((1 + many) / (1 + c))
    return out


def _summed(held: DataFrame, weights: np.ndarray, directions: np.ndarray, squared: bool) -> np.ndarray:
    """A'A times the directions (or, ``squared``, their l x l product through A), summed over all texts by blocks."""
    n, l = directions.shape  # noqa: E741
    columns = np.ascontiguousarray(directions.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((l, l if squared else n))
        for batch in _batches(batches):
            rows, ids, values = weighted(*_triples(batch), weights, len(batch))
            if not len(rows):
                continue
            # a direction at a time, so that what is looked up and added to stays in the cache
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            through = np.zeros((l, len(batch)))
            for one, d in zip(through, columns, strict=True):
                one[rows[first]] = np.add.reduceat(values * d[ids], first)
            if squared:
                total += through @ through.T
            else:
                many = np.diff(first, append=len(rows))
                for one, t in zip(total, through, strict=True):
                    one += np.bincount(ids, values * np.repeat(t[rows[first]], many), n)
        total = np.ascontiguousarray(total.T)
        blocks = [(k // BLOCK, total[k : k + BLOCK]) for k in range(0, len(total), BLOCK)]
        kept = [(k, b.tobytes()) for k, b in blocks if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), pa.array([b for _, b in kept], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype=np.float64) for b in table.column("part").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    parts = held.mapInArrow(run, "block int, part binary")
    out = np.zeros((l if squared else n, l))
    for r in parts.groupBy("block").applyInArrow(add, "block int, part binary").collect():
        part = np.frombuffer(r.part, dtype=np.float64).reshape(-1, l)
        out[r.block * BLOCK : r.block * BLOCK + len(part)] = part
    return out


def fit(df: DataFrame, text: str = "text", dims: int = 64, n: int = FEATURES, passes: int = PASSES) -> Vectors:
    """The model of a corpus: one read of its texts, ``passes`` + 2 of their counts; null and empty texts teach nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    # small row groups, so that the passes have many tasks where the texts had few
    counted(df, text, n).write.option("parquet.block.size", 8 << 20).parquet(path)
    # a task's sums have the size of the model whatever it reads, so there are as many tasks as cores at most
    held = spark.read.schema("ids binary, n binary").parquet(path).coalesce(spark.sparkContext.defaultParallelism)
    weights = document_weights(held, n)
    directions = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, dims + EXTRA)))[0]
    for _ in range(passes):
        directions = np.linalg.qr(_summed(held, weights, directions, squared=False))[0]
    values, turned = np.linalg.eigh(_summed(held, weights, directions, squared=True))
    remove(spark, path)
    best = np.argsort(-values)[:dims]
    return Vectors(weights, directions @ turned[:, best])
