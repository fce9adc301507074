"""Bloom filters that live on: one that grows with every batch, and one of three generations in a stream's state."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarn.operators import bloom
from tarn.operators.graph import cut_lineage
from tarn.sources.versioned import CommitLog

#: Each layer holds four times the one before (two times where memory counts), at nine tenths of its error.
GROWTH, SMALL_GROWTH, RATIO = 4, 2, 0.9
#: Bitmaps of a layer in so many parts are put together.
MOST_PARTS = 8


class GrowingFilter:
    """Layers of bitmaps below a folder: a batch fills the newest one and opens more as it needs them.

    A layer is never made again; its bitmaps are parts that are ORed when
    read.  What every layer was made for, how much it holds and where its parts
    are is an entry of a commit log.
    """

    def __init__(self, spark: SparkSession, path: str, initial: int = 100, error: float = 0.001, growth: int = GROWTH):
        self.spark, self.path, self.initial, self.error, self.growth = spark, path, initial, error, growth
        self.log = CommitLog(spark, f"{path}/_log")

    def layers(self) -> list[dict]:
        return self.log.latest()[1] or []

    def _bitmaps(self, layer: dict) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{p}" for p in layer["parts"]])
        return rows if len(layer["parts"]) == 1 else bloom.union(rows)

    def probe(self, df: DataFrame, column: str) -> DataFrame:
        """Distinct values with ``maybe``, the newest layer asked first; a value that one says yes to is not asked again."""
        left = df.select(F.col(column).alias("v")).where("v is not null").distinct()
        found = left.select("v", F.lit(True).alias("maybe")).limit(0)
        for layer in reversed(self.layers()):
            asked = bloom.probe(left, "v", self._bitmaps(layer), layer["items"], layer["error"])
            found = found.unionByName(asked.where("maybe"))
            left = asked.where("not maybe").select("v")
        return found.unionByName(left.select("v", F.lit(False).alias("maybe"))).withColumnRenamed("v", column)

    def add(self, df: DataFrame, column: str) -> int:
        """Adds the values that no layer holds yet; their number.

        They are dealt to the room in the newest layer and in as many new ones
        as it takes, by a hash, so that none is filled over its size but for
        the chance of the deal, which is allowed for.
        """
        version, found = self.log.latest()
        layers = [dict(x) for x in found or []]
        new = cut_lineage(self.probe(df, column).where("not maybe").select(F.col(column).alias("v")))
        many = new.count()
        if not many:
            return 0

        def room(x: dict) -> int:
            free = x["items"] - x["count"]
            return max(0, int(free - 3 * math.sqrt(free))) if free > 9 else 0

        if not layers:
            layers.append({"items": self.initial, "error": self.error * RATIO, "count": 0, "parts": []})
        first = len(layers) - 1
        while sum(map(room, layers[first:])) < many:
            last = layers[-1]
            layers.append({"items": last["items"] * self.growth, "error": last["error"] * RATIO, "count": 0, "parts": []})
        open_ = layers[first:]
        total, base = sum(map(room, open_)), 0
        place = F.pmod(F.xxhash64("v", F.lit(version)), F.lit(total))
        dealt = new.withColumn("place", place)
        for x in open_:
            mine = dealt.where((F.col("place") >= base) & (F.col("place") < base + room(x)))
            base += room(x)
            n = mine.count()
            if not n:
                continue
            part = f"part-{uuid.uuid4().hex}"
            bloom.build(mine, "v", x["items"], x["error"]).write.parquet(f"{self.path}/{part}")
            x["parts"] = [*x["parts"], part]
            x["count"] += n
            if len(x["parts"]) > MOST_PARTS:
                one = f"part-{uuid.uuid4().hex}"
                self._bitmaps(x).write.parquet(f"{self.path}/{one}")
                x["parts"] = [one]
        self.log.commit(version, [x for x in layers if x["parts"]])
        return many


class Generations(StatefulProcessor):
    """Which values came before in this or the last generations, by one bitmap for each.

    The state of a key is ``kept`` bitmaps, newest first.  A generation lasts
    ``seconds``; when a new one begins the oldest bitmap is dropped.  A value
    may be taken for seen by chance, but never for new if it was seen.
    """

    def __init__(self, seconds: int, kept: int = 3, items: int = 10_000, error: float = 1e-6):
        self.seconds, self.kept = seconds, kept
        self.hashes, self.width = bloom.sizes(items, error)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filters = handle.getValueState("filters", "generation long, bits array<binary>")

    def _places(self, value: str) -> np.ndarray:
        both = xxhash.xxh3_128_intdigest(value)
        low, high = both & 0xFFFFFFFFFFFFFFFF, both >> 64 | 1
        return np.array([(low + k * high) % 2**64 % self.width + k * self.width for k in range(self.hashes)], dtype=np.int64)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        size = -(-self.hashes * self.width // 8)
        if self.filters.exists():
            now, bits = self.filters.get()
            maps = [np.frombuffer(b, dtype=np.uint8).copy() for b in bits]
        else:
            now, maps = None, []
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        seen = []
        for at, value in batch[["at", "value"]].itertuples(index=False):
            g = int(at) // self.seconds
            now = g if now is None else now
            if not maps:
                maps = [np.zeros(size, dtype=np.uint8)]
            for _ in range(min(max(0, g - now), self.kept)):
                maps.insert(0, np.zeros(size, dtype=np.uint8))
            now = max(now, g)
            del maps[self.kept :]
            places = self._places(str(value))
            byte, bit = places >> 3, np.left_shift(1, places & 7).astype(np.uint8)
            seen.append(any((m[byte] & bit).all() for m in maps))
            np.bitwise_or.at(maps[0], byte, bit)
        self.filters.update((now, [m.tobytes() for m in maps]))
        yield pd.DataFrame({"seq": batch["seq"].astype("int64"), "value": batch["value"].astype(str), "seen": seen})

    def close(self) -> None:
        pass


def generations_stream(events: DataFrame, seconds: int, kept: int = 3, items: int = 10_000, error: float = 1e-6, shards: int = 16) -> DataFrame:
    """(seq, value, seen) of a stream (at, seq, value): whether the value came before in the last ``kept`` generations.

    Values are dealt to ``shards`` keys, each with filters for ``items`` values a generation.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    dealt = events.select("at", "seq", F.col("value").cast("string").alias("value")).withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards)))
    return dealt.groupBy("shard").transformWithStateInPandas(Generations(seconds, kept, items, error), "seq long, value string, seen boolean", "Append", "None")
