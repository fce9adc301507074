"""Shared helpers of the training-data operators.

Conventions that hold for every operator here:

* An operator names the columns it reads and selects only those, so extra
  columns of any name (even one that clashes with an output) are never read.
* A null text counts as the empty text unless an operator says otherwise.
* Rows are never dropped, capped or sampled; repeated rows give repeated rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared folder, for as long as the block lasts.

    For large intermediate rows: columns compress, which checkpoints do not.
    What the block returns must not depend on the table any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without the setting: it gets a temporary
    folder.  On a cluster such a folder would not be shared, so that is an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {key} to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
        spark.conf.set(key, found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: ten thousand long texts at once are no use to any operator."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_held: dict[str, Any] = {}
_stage: list = [None]


def held(name: str, make: Callable[[], Any]) -> Any:
    """A worker's state for the running stage (vocabularies, caches), made on first use."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def fresh() -> None:
    """Drop what another stage held in this worker."""
    from pyspark import TaskContext

    task = TaskContext.get()
    stage = task and task.stageId()
    if _stage[0] != stage:
        _held.clear()
        _stage[0] = stage


def tidy() -> None:
    """Give freed memory back to the system; reused workers would keep it for good."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``: what another stage held in this worker goes first, freed memory at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: str, budget: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``budget`` bytes of text each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(batch):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    keys: list[str],
    text: str,
    schema: str,
    work: Callable[..., dict],
    budget: int = 1_000_000,
    with_key: str | None = None,
) -> DataFrame:
    """``mapInArrow`` over (keys, text): ``work`` gets a list of texts and returns the new columns.

    No shuffle: a task streams its Arrow batches, cut so that about ``budget``
    bytes of text are worked on at once.  ``schema`` lists the new columns.
    With ``with_key`` the values of that key are a list before the texts.
    """
    from pyspark.sql.types import StructType

    source = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    new = StructType.fromDDL(schema)
    out = StructType([*[source.schema[k] for k in keys], *new.fields])
    names = [f.name for f in new.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", budget):
                texts = part.column("__text").to_pylist()
                made = work(texts) if with_key is None else work(part.column(with_key).to_pylist(), texts)
                cols = [part.column(k).cast(arrow.field(k).type) for k in keys]
                for n in names:
                    v = made[n]
                    cols.append(v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(n).type))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    small_batches(df.sparkSession)
    return source.mapInArrow(lean(run), out)


def map_rows(df: DataFrame, text: str, work: Callable[[list[str | None]], dict], keep: bool = False, budget: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` with some columns replaced (or, with ``keep``, some rows left out); the schema stays.

    ``work`` gets a list of texts and returns new columns by name; with ``keep``
    its ``kept`` is a mask instead.  No shuffle, no join back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, budget):
                made = work(part.column(text).to_pylist())
                if keep:
                    yield part.filter(pa.array(made["kept"], pa.bool_()))
                    continue
                cols = [pa.array(made[f.name], type=f.type) if f.name in made else part.column(i) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(f.name, c.type, True) for f, c in zip(arrow, cols, strict=True)]))

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run), df.schema)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; TARN_TOKENIZERS overrides the folder."""
    folder = os.environ.get("TARN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
