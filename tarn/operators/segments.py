"""An inverted index that takes changes: segments, tombstones, merges.

Every batch of documents becomes a segment of its own: postings by term bucket,
and the documents with their lengths.  A document that comes again, or is
deleted, gets a tombstone in each older segment that holds it; postings are
never changed.  When several segments of like size have gathered, a merge
rewrites them as one without what is dead.  The list of segments is an entry of
a commit log, so that readers see whole versions and writers that meet try
again.  ``view`` gives all this as the index that ``search.lexical`` reads.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import tokens
from tarn.operators.search import PARTS, KeptIndex, counted, dealt
from tarn.sources.versioned import ATTEMPTS, CommitLog, Conflict

#: A merge takes the segments of a tier once there are so many; a tier holds sizes within this factor.
TIER = 4
#: Characters of text for each bucket of terms, and buckets at least and at most.
BUCKET_CHARS, LEAST_BUCKETS, MOST_BUCKETS = 16_000_000, 4, 4096


@dataclass
class Written:
    """What a batch did: documents indexed, those of them that replaced one, those that were to go and were not there."""

    indexed: int = 0
    replaced: int = 0
    deleted: int = 0
    missing: int = 0


class SegmentedIndex:
    """Documents (key and text columns by field) below a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/_log")

    def _segments(self) -> tuple[int, list[dict]]:
        version, entry = self.log.latest()
        return version, entry or []

    def _table(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment['name']}/{name}")

    def _dead(self, segment: dict) -> DataFrame | None:
        """Keys of a segment that are dead."""
        paths = [f"{self.path}/{t}" for t in segment["dead"]]
        return self.spark.read.parquet(*paths).select("doc").distinct() if paths else None

    def _live(self, segment: dict, name: str) -> DataFrame:
        rows, dead = self._table(segment, name), self._dead(segment)
        return rows if dead is None else rows.join(dead, "doc", "left_anti")

    def _all(self, segments: list[dict], name: str, schema: str) -> DataFrame:
        out = None
        for s in segments:
            out = self._live(s, name) if out is None else out.unionByName(self._live(s, name))
        return self.spark.createDataFrame([], schema) if out is None else out

    def _write(self, postings: DataFrame, lengths: DataFrame, chars: int) -> dict:
        """A segment of (field, term, doc, tf, len) and (field, doc, len) rows."""
        name = f"segment-{uuid.uuid4().hex}"
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, chars // BUCKET_CHARS))
        # by bucket and term, so that a query reads the row groups of its terms
        dealt(postings, buckets, PARTS).drop("bucket").write.parquet(f"{self.path}/{name}/postings")
        lengths.write.parquet(f"{self.path}/{name}/documents")
        n = self.spark.read.parquet(f"{self.path}/{name}/documents").select("doc").distinct().count()
        return {"name": name, "docs": n, "chars": chars, "dead": []}

    def _commit(self, change) -> Written:
        """Applies ``change`` (segments -> new segments and what it did) to the last version, again if it is not the last any more."""
        for _ in range(ATTEMPTS):
            version, segments = self._segments()
            new, done = change([s | {"dead": list(s["dead"])} for s in segments])
            try:
                self.log.commit(version, new)
            except Conflict:
                continue
            return done
        raise Conflict(f"{self.path} changed {ATTEMPTS} times while it was read")

    def _bury(self, segments: list[dict], keys: DataFrame) -> tuple[list[dict], int]:
        """Tombstones for the live documents of ``keys`` in the segments; how many documents died."""
        died = 0
        for s in segments:
            there = self._live(s, "documents").select("doc").distinct().join(keys, "doc", "left_semi")
            name = f"dead-{uuid.uuid4().hex}"
            there.write.parquet(f"{self.path}/{name}")
            n = self.spark.read.parquet(f"{self.path}/{name}").count()
            if n:
                s["dead"].append(name)
                s["docs"] -= n
                died += n
        return segments, died

    def add(self, docs: DataFrame, key: str, fields: dict[str, Column], analyze: Callable[[Column], Column] = tokens) -> Written:
        """Indexes a batch; a document of a key that is there already replaces it.  Keys are distinct within a batch.

        ``analyze`` makes an array of terms of a text; queries are to use the same.
        """
        rows = docs.select(F.col(key).alias("doc"), *[text.alias(f"f_{name}") for name, text in fields.items()])
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(analyze(F.col(f"f_{n}")), F.array().cast("array<string>")).alias("t")) for n in fields]))
        cut = rows.select("doc", each.alias("x")).select("doc", "x.field", "x.t", F.size("x.t").cast("long").alias("len"))
        chars = rows.agg(*[F.coalesce(F.sum(F.length(f"f_{n}")), F.lit(0)) for n in fields]).first()
        segment = self._write(counted(cut.select("field", "doc", F.col("t").alias("tokens"))), cut.select("field", "doc", "len"), int(sum(chars)))
        keys = self._table(segment, "documents").select("doc").distinct()

        def change(segments: list[dict]) -> tuple[list[dict], Written]:
            segments, died = self._bury(segments, keys)
            return [*segments, segment], Written(indexed=segment["docs"], replaced=died)

        return self._commit(change)

    def delete(self, keys: DataFrame, key: str = "doc") -> Written:
        wanted = keys.select(F.col(key).alias("doc")).distinct()

        def change(segments: list[dict]) -> tuple[list[dict], Written]:
            segments, died = self._bury(segments, wanted)
            return segments, Written(deleted=died, missing=wanted.count() - died)

        return self._commit(change)

    def merge(self) -> int:
        """Merges each tier that is full; the number of segments then.  A change in between makes it begin again."""

        def tier(s: dict) -> int:
            return int(math.log(max(1, s["docs"]), TIER))

        def change(segments: list[dict]) -> tuple[list[dict], int]:
            for level in sorted({tier(s) for s in segments}):
                group = [s for s in segments if tier(s) == level]
                if len(group) >= TIER:
                    posts = self._all(group, "postings", "field string")
                    made = self._write(posts, self._all(group, "documents", "field string"), sum(s["chars"] for s in group))
                    segments = [s for s in segments if s not in group] + [made]
            return segments, len(segments)

        return self._commit(change)

    def segments(self) -> int:
        return len(self._segments()[1])

    def view(self) -> KeptIndex:
        """The live documents as an index: scores are those of one built from them at once.

        Document counts and mean lengths are one row per field; the frequency
        of a term is counted from its live postings when it is asked for.
        """
        segments = self._segments()[1]
        posts = self._all(segments, "postings", "field string, term string, doc long, tf long, len long")
        lengths = self._all(segments, "documents", "field string, doc long, len long")
        stats = lengths.where("len > 0").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).collect()
        terms = posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).withColumn("letter", F.substring("term", 1, 1))
        return KeptIndex(posts, terms, {r.field: (r.n, r.mean) for r in stats}, None)
