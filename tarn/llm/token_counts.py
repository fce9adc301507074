"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies, and summed.

A text is cut at ASCII white space into runs; no pre-token and no special
string of the vocabulary spans white space, so a text's count is the sum over
its runs.  Every text becomes a frequency table of its distinct runs; the
distinct runs of a slice of texts are looked up once, each split into the
library's own pre-tokens, and each distinct pre-token is counted once by the
library's model.  The frequency rows then take their run's count by run number
and are summed per text.  No token ids are kept at any point.

``token_counts`` joins inside a slice of texts and shuffles nothing; counts of
distinct runs are kept in a worker up to ``CACHE_BYTES``.
``token_counts_joined`` is the same over the whole corpus as a DataFrame join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import held, lean, map_texts, slices, tokenizer_path

TOKEN_LIMIT = 2048
#: Bytes of runs and pre-tokens whose counts a worker keeps, and what an entry costs beside them.
CACHE_BYTES = 48_000_000
ENTRY_BYTES = 120
#: Longer runs are counted each time they come, not kept.
LONG_RUN = 1000
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"


class Counts:
    """Run -> number of tokens by the vocabulary's library, filled on demand and bounded in bytes."""

    def __init__(self, path: str):
        if not path.endswith(".json"):
            raise ValueError(f"runs cannot be counted apart for {path}")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.runs: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}
        self.kept = 0

    def _keep(self, table: dict, key: bytes | str, n: int) -> int:
        if len(key) <= LONG_RUN:
            if self.kept >= CACHE_BYTES:
                self.runs.clear()
                self.pieces.clear()
                self.kept = 0
            table[key] = n
            self.kept += ENTRY_BYTES + len(key)
        return n

    def _of_piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        return n if n is not None else self._keep(self.pieces, piece, len(self.lib.model.tokenize(piece)))

    def _of_run(self, raw: bytes) -> int:
        run = raw.decode("utf-8")
        if any(s in run for s in self.special):
            return len(self.lib.encode(run, add_special_tokens=False).ids)
        text = self.lib.normalizer.normalize_str(run) if self.lib.normalizer else run
        return sum(self._of_piece(piece) for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(text))

    def of(self, distinct: list[bytes]) -> np.ndarray:
        out = np.empty(len(distinct), dtype=np.int64)
        for i, raw in enumerate(distinct):
            n = self.runs.get(raw)
            out[i] = n if n is not None else self._keep(self.runs, raw, self._of_run(raw))
        return out


def _counts(path: str) -> Counts:
    return held(f"counts {path}", lambda: Counts(path))


def token_counts(
    df: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    key: str = "doc_id",
    text: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row; a null or empty text has 0 of each.

    Texts are counted whole at any length and each by itself: repeated rows
    give repeated rows, and equal texts equal counts.  Only the key and the
    text are read, so columns named like a result do no harm.
    """
    path = tokenizer_path(tokenizer)

    def work(texts: list[str | None]) -> dict:
        number: dict[bytes, int] = {}
        fresh = count()
        runs, times = [], []
        per, size = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for d, t in enumerate(texts):
            raw = (t or "").encode("utf-8")
            size[d] = len(raw)
            seen = Counter(raw.split())
            per[d] = len(seen)
            if seen:
                runs.append(np.fromiter(map(number.setdefault, seen, fresh), dtype=np.int64, count=len(seen)))
                times.append(np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
        total = np.zeros(len(texts), dtype=np.int64)
        if runs:
            run = np.concatenate(runs)
            pieces = np.zeros(int(run.max()) + 1, dtype=np.int64)
            pieces[np.fromiter(number.values(), dtype=np.int64, count=len(number))] = _counts(path).of(list(number))
            doc = np.repeat(np.arange(len(texts)), per)
            total = np.bincount(doc, weights=pieces[run] * np.concatenate(times), minlength=len(texts)).astype(np.int64)
        return {"n_bytes": size, "n_tokens": total, "over_limit": total > limit}

    return map_texts(df, [key], text, SCHEMA, work)


def token_counts_joined(df: DataFrame, tokenizer: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) per row with at least one token, by a join over the whole corpus.

    Every text ships a row per distinct run, (key, mark, run, times); each
    distinct run of the corpus is counted once, and counts meet frequencies in
    a join by run.  Rows of equal key and text are one group: their sum is the
    sum over all of them.
    """
    path = tokenizer_path(tokenizer)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                seen = [Counter((t or "").encode("utf-8").split()) for t in part.column("text").to_pylist()]
                own = np.repeat(np.arange(len(seen)), [len(c) for c in seen])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(own)),
                        part.column("mark").take(pa.array(own)),
                        pa.array([r for c in seen for r in c], pa.binary()),
                        pa.array([n for c in seen for n in c.values()], pa.int64()),
                    ],
                    names=["key", "mark", "run", "times"],
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(_counts(path).of(batch.column("run").to_pylist()))], names=["run", "pieces"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    table = rows.mapInArrow(lean(frequencies), f"key {kind}, mark long, run binary, times long")
    pieces = table.select("run").distinct().mapInArrow(lean(counted), "run binary, pieces long")
    summed = table.join(pieces, "run").groupBy("key", "mark").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_tokens"))
    return summed.select(F.col("key").alias(key), "n_tokens")
