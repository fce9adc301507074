"""Tables that several writers change at once: a commit log, compare-and-set commits, conditional updates of rows.

A table is a folder of data and a log of numbered entries; an entry names all
data that its version consists of.  A writer says which version it has read and
claims the next number; who comes second loses and reads again.  Readers see
whole versions only.  Claiming needs a file system whose rename does not
replace (HDFS), or hard links (local files).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from tarn.operators.graph import cut_lineage
from tarn.sources.shared import _fs, exists, remove

ATTEMPTS = 10


class Conflict(RuntimeError):
    """Another writer has committed since the version that was read."""


class CommitLog:
    """Numbered entries below a folder; each number is taken once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _entry(self, version: int) -> str:
        return f"{self.path}/{version:020d}.json"

    def latest(self) -> tuple[int, Any]:
        """(version, its entry); (-1, None) if there is none."""
        fs, at = _fs(self.spark, self.path)
        if not fs.exists(at):
            return -1, None
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]
        return (max(versions), self.entry(max(versions))) if versions else (-1, None)

    def entry(self, version: int) -> Any:
        fs, at = _fs(self.spark, self._entry(version))
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def commit(self, base: int, entry: Any) -> int:
        """The number after ``base``, now with this entry; ``Conflict`` if it is taken."""
        jvm = self.spark.sparkContext._jvm
        beside, place = f"{self.path}/.{uuid.uuid4().hex}", self._entry(base + 1)
        fs, at = _fs(self.spark, beside)
        stream = fs.create(at, True)
        stream.write(bytearray(json.dumps(entry).encode("utf-8")))
        stream.close()
        try:
            if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
                local = lambda p: jvm.java.io.File(jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()).toPath()
                try:
                    jvm.java.nio.file.Files.createLink(local(place), local(beside))
                    taken = True
                except Exception as e:
                    if "FileAlreadyExists" not in str(e):
                        raise
                    taken = False
            else:
                taken = fs.rename(at, jvm.org.apache.hadoop.fs.Path(place))
        finally:
            if fs.exists(at):
                fs.delete(at, False)
        if not taken:
            raise Conflict(f"version {base + 1} of {self.path} is taken")
        return base + 1


@dataclass
class Outcome:
    version: int
    applied: int
    refused: DataFrame  # the changes that met another version of their row


class VersionedTable:
    """Rows by key with a version each, in buckets by the key's hash; a commit rewrites the buckets it touches.

    ``column`` counts the changes of a row, from 1.
    """

    def __init__(self, spark: SparkSession, path: str, column: str = "version"):
        self.spark, self.path, self.column = spark, path, column
        self.log = CommitLog(spark, f"{path}/_log")

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 16, column: str = "version") -> VersionedTable:
        """A new table of rows with distinct keys, each of version 1."""
        table = cls(df.sparkSession, path, column)
        rows = df.withColumn(column, F.lit(1).cast("long"))
        entry = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "places": {}}
        table.log.commit(-1, table._with(entry, rows, list(range(buckets))))
        return table

    def _with(self, entry: dict, rows: DataFrame, buckets: list[int]) -> dict:
        """``entry`` with these buckets' rows written anew."""
        name = f"commit={uuid.uuid4().hex}"
        rows.withColumn("__bucket", F.pmod(F.xxhash64(entry["key"]), F.lit(entry["buckets"])).cast("int")).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        return entry | {"places": entry["places"] | {str(b): name for b in buckets}}

    def _read(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        fields = StructType.fromJson(entry["schema"])
        wanted = entry["places"] if buckets is None else {str(b): entry["places"][str(b)] for b in buckets}
        paths = [p for b, name in sorted(wanted.items()) if exists(self.spark, p := f"{self.path}/data/{name}/__bucket={b}")]
        return self.spark.read.schema(fields).parquet(*paths) if paths else self.spark.createDataFrame([], fields)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last one."""
        return self._read(self.log.entry(version) if version is not None else self.log.latest()[1])

    def update(self, changes: DataFrame, before_commit: Callable[[], None] | None = None) -> Outcome:
        """Applies the changes whose row still has the version they expect.

        ``changes`` has the key, ``expected`` (null: there must be no such
        row), new values under their columns' names (null: as it was) and, if
        wanted, ``removes``: names of columns to empty, or ``gone``: true for a
        row to delete.  Of several changes of one key the least by all columns
        that have an order counts and the others are refused.
        Another writer's commit in between makes this one judge anew where it
        touched the same buckets.
        """
        base, entry = self.log.latest()
        key, column = entry["key"], self.column
        asked = changes.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(entry["buckets"])).cast("int"))
        columns = changes.columns
        first = F.row_number().over(_order(key, [f.name for f in changes.schema if not isinstance(f.dataType, MapType)])) == 1
        asked = cut_lineage(asked.withColumn("__first", first))
        touched = sorted(r[0] for r in asked.select("__bucket").distinct().collect())
        for _ in range(ATTEMPTS):
            old = self._read(entry, touched)
            theirs = asked.select(F.col(key).alias("__key"), F.col("expected").alias("__expected"), "__first", *[F.col(c).alias(f"__new_{c}") for c in columns if c not in (key, "expected")])
            met = old.select(F.col(key).alias("__old"), F.struct(*old.columns).alias("__row"))
            judged = theirs.join(met, F.col("__key") == F.col("__old"), "left")
            same = F.when(F.col("__expected").isNull(), F.col("__old").isNull()).otherwise(F.coalesce(F.col(f"__row.{column}") == F.col("__expected"), F.lit(False)))
            judged = cut_lineage(judged.withColumn("__good", F.col("__first") & same))

            def value(c: str):
                new = F.col(f"__new_{c}") if c in columns else F.lit(None)
                kept = F.coalesce(new.cast(old.schema[c].dataType), F.col(f"__row.{c}"))
                return F.when(F.array_contains("__new_removes", c), None).otherwise(kept) if "removes" in columns else kept

            made = {key: F.col("__key"), column: F.coalesce(F.col(f"__row.{column}"), F.lit(0).cast("long")) + 1}
            good = judged.where("__good")
            if "gone" in columns:
                good = good.where(~F.coalesce("__new_gone", F.lit(False)))
            changed = good.select(*[(made[c] if c in made else value(c)).alias(c) for c in old.columns])
            stay = old.join(judged.where("__good").select(F.col("__key").alias(key)), key, "left_anti").select(*old.columns)
            written = self._with(entry, stay.unionByName(changed), touched)
            if before_commit:
                before_commit()
                before_commit = None
            while True:
                try:
                    version = self.log.commit(base, written)
                except Conflict:
                    base, found = self.log.latest()
                    mine = {str(b) for b in touched}
                    clash = any(found["places"][b] != entry["places"][b] for b in mine)
                    # others' buckets are taken over as they are now
                    written = found | {"places": found["places"] | {b: written["places"][b] for b in mine}}
                    entry = found
                    if clash:
                        break
                    continue
                applied = judged.where("__good").count()
                refused = judged.where("not __good").select(F.col("__key").alias(key), F.col("__expected").alias("expected"), *[F.col(f"__new_{c}").alias(c) for c in columns if c not in (key, "expected")])
                return Outcome(version, applied, refused)
        raise Conflict(f"{self.path} changed {ATTEMPTS} times while it was read")

    def vacuum(self, keep: int = 2) -> None:
        """Removes data that none of the last ``keep`` versions names."""
        last = self.log.latest()[0]
        named = {name for v in range(max(0, last - keep + 1), last + 1) for name in self.log.entry(v)["places"].values()}
        fs, at = _fs(self.spark, f"{self.path}/data")
        for s in fs.listStatus(at):
            if s.getPath().getName() not in named:
                remove(self.spark, s.getPath().toString())


def _order(key: str, columns: list[str]):
    return Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in columns if c != key])
