"""Substring dedup by sliding sentence spans.

A text is cut into sentences.  At every sentence starts one span and ends one
span: the shortest run of at least ``LEAST_SENTENCES`` sentences with at least
``LEAST_WORDS`` words (a single sentence of ``LONE_WORDS`` words is a span of
its own).  Every span is hashed and all spans of all texts meet by hash; the
first occurrence, by key and position, stays, and every sentence that a later
occurrence covers is removed.  A row is known by its key and a hash of its
text, so rows of equal key and different texts are documents of their own.
That is the same as hashing every run of that
least size: each sentence of such a run lies in the span that starts with the
run or in the span that ends at the sentence, and both lie inside the run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.llm.common import cut, lean, slices, small_batches, written

LEAST_SENTENCES = 2
LEAST_WORDS = 20
LONE_WORDS = 30

_END = re.compile(r"[.!?]+[\"'»”)\]]*\s+|[。！？]+[」』”）]*\s*|\s*\n\s*")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")


def sentences(text: str) -> tuple[list[int], list[str]]:
    """(starts and one end, normal forms): a sentence reaches up to the next one's start.

    The normal form is lower-cased with single spaces; pieces without a word
    belong to the sentence before.
    """
    starts, forms = [], []
    at = 0
    for m in _END.finditer(text):
        form = " ".join(text[at : m.end()].lower().split())
        if form:
            starts.append(at)
            forms.append(form)
        elif not starts:
            continue
        at = m.end()
    form = " ".join(text[at:].lower().split())
    if form:
        starts.append(at)
        forms.append(form)
    if starts:
        starts[0] = 0
    return [*starts, len(text)], forms


def words_in(form: str) -> int:
    """Words of a normal form; of scripts without spaces every character is one."""
    blanks = form.count(" ") + 1
    return blanks if form.isascii() else blanks + len(_UNSPACED.findall(form))


def spans(forms: list[str]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, end) of every lone sentence and of the span that starts at each sentence."""
    out = []
    counts = list(map(words_in, forms))
    end, words, n = 0, 0, len(forms)
    for i in range(n):
        if end < i:
            end, words = i, 0
        if counts[i] >= LONE_WORDS:
            out.append((xxhash.xxh3_64_intdigest(forms[i]), i, i + 1))
        while end < n and (end - i < LEAST_SENTENCES or words < LEAST_WORDS):
            words += counts[end]
            end += 1
        if end - i >= LEAST_SENTENCES and words >= LEAST_WORDS:
            out.append((xxhash.xxh3_64_intdigest("\n".join(forms[i:end])), i, end))
        words -= counts[i]
    return out


def closing_spans(forms: list[str]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, end) of the span that ends at each sentence, where none of ``spans`` is the same run."""
    out = []
    counts = list(map(words_in, forms))
    start, words = 0, 0
    for end in range(1, len(forms) + 1):
        last = counts[end - 1]
        words += last
        while end - start > LEAST_SENTENCES and words - counts[start] >= LEAST_WORDS:
            words -= counts[start]
            start += 1
        # without its last sentence the run is still long enough, so no span starts with it
        if end - start > LEAST_SENTENCES and words - last >= LEAST_WORDS:
            out.append((xxhash.xxh3_64_intdigest("\n".join(forms[start:end])), start, end))
    return out


def span_table(df: DataFrame, closing: bool = True) -> DataFrame:
    """(doc, mark, hash, start, stop) of (doc, mark, text): one row per span, with those of ``closing_spans`` if asked.

    Positions are sentence numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, per = [], np.zeros(len(part), dtype=np.int64)
                for d, t in enumerate(part.column("text").to_pylist()):
                    forms = sentences(t)[1]
                    mine = spans(forms) + closing_spans(forms) if closing else spans(forms)
                    per[d] = len(mine)
                    found += mine
                if found:
                    hashes, starts, stops = zip(*found, strict=True)
                    own = pa.array(np.repeat(np.arange(len(part)), per))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc").take(own),
                            part.column("mark").take(own),
                            pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                            pa.array(starts, pa.int32()),
                            pa.array(stops, pa.int32()),
                        ],
                        names=["doc", "mark", "hash", "start", "stop"],
                    )

    small_batches(df.sparkSession)
    schema = StructType([df.schema["doc"], *StructType.fromDDL("mark long, hash long, start int, stop int").fields])
    return df.select("doc", "mark", "text").where("text is not null").mapInArrow(lean(run), schema)


def repeated(table: DataFrame) -> DataFrame:
    """(doc, mark, spans): for each text the sentence ranges of its non-first repeated spans in a span table.

    First occurrences are found map-side first, so a very frequent span meets
    as one row per task; they are written before spans are joined to them, so
    that both sides of the join are plain exchanges and a frequent hash can be
    split over tasks.
    """
    place = F.struct("doc", "mark", "start")
    firsts = table.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    later = table.join(cut(firsts), "hash").where(place != F.col("first"))
    return later.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the sentences in the ranges, sentences, sentences removed)."""
    starts, forms = sentences(text)
    gone = np.zeros(len(forms), dtype=bool)
    for a, b in ranges:
        gone[a:b] = True
    if not gone.any():
        return text, len(forms), 0
    kept = "".join(text[starts[i] : starts[i + 1]] for i in range(len(forms)) if not gone[i])
    return kept.strip() if gone[-1] or gone[0] else kept, len(forms), int(gone.sum())


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", closing: bool = True) -> DataFrame:
    """(key, text, n_sentences, n_removed) per row of ``df``.

    ``closing`` takes the whole rule; without it only the spans that start at
    each sentence count, and the end of a repeated passage may stay.

    The text is unchanged where nothing is removed; a text that repeats others
    wholly becomes empty.  Null stays null with 0 sentences.  Keys may be of
    any type that has an order; a null key is a key like others, before all.
    Rows of equal key and text are one document, so they do not remove each
    other; rows of equal key and different texts are different documents, in
    the order of their texts' hashes.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    with written(span_table(rows, closing)) as table:
        found = cut(repeated(table))
    found = found.select(F.col("doc").alias("of"), F.col("mark").alias("marked"), "spans")
    packed = rows.join(found, F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("marked")), "left").select(F.col("doc").alias(key), F.col("text").alias("__t"), "spans")
    schema = StructType([*df.select(F.col(f"`{key}`")).schema.fields, *StructType.fromDDL("text string, n_sentences long, n_removed long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__t"):
                made = []
                for t, ranges in zip(part.column("__t").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    made.append((None, 0, 0) if t is None else without(t, [(r["start"], r["stop"]) for r in ranges or ()]))
                texts, n, gone = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return packed.mapInArrow(lean(run), schema)

