"""A message queue on a versioned table: visibility time-outs, receipts, redelivery, dead letters, partial failures.

Consumers race for messages by conditional updates: who moves a message's
version first has it, hidden from others for a while and under a receipt of
its own.  A message that is not acknowledged in time comes again; one that has
come too often is moved aside.  Times are seconds and given by the caller.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.graph import cut_lineage
from tarn.sources.versioned import VersionedTable

#: The longest body in bytes, seconds a message is hidden, deliveries before it is moved aside.
MOST_BYTES, VISIBILITY, MOST_RECEIVED = 262_144, 300, 3
SCHEMA = "id string, body string, attributes map<string,string>, sent long, visible_at long, receipt string, received int, dead boolean"


class Queue:
    def __init__(self, spark: SparkSession, path: str, visibility: int = VISIBILITY, most_received: int = MOST_RECEIVED, buckets: int = 16):
        self.spark, self.visibility, self.most_received = spark, visibility, most_received
        self.table = VersionedTable(spark, path)
        if self.table.log.latest()[0] < 0:
            self.table = VersionedTable.create(spark.createDataFrame([], SCHEMA), path, "id", buckets)

    def send(self, messages: DataFrame, now: int, delay: int = 0) -> DataFrame:
        """Sends (id, body[, attributes]); returns (id, error) of those that failed: no body, too long, or an id that is taken.

        A failure of some messages does not hold up the others.
        """
        attributes = F.col("attributes") if "attributes" in messages.columns else F.create_map().cast("map<string,string>")
        size = F.octet_length("body")
        wrong = F.when(F.col("body").isNull() | (F.col("body") == ""), "empty").when(size > MOST_BYTES, "too long")
        marked = messages.select(F.col("id").cast("string").alias("id"), F.col("body"), attributes.alias("attributes"), wrong.alias("error"))
        good = marked.where("error is null").select("id", "body", "attributes")
        new = good.select("id", F.lit(None).cast("long").alias("expected"), "body", "attributes", F.lit(now).cast("long").alias("sent"), F.lit(now + delay).cast("long").alias("visible_at"), F.lit(0).alias("received"), F.lit(False).alias("dead"))
        # attributes cannot be ordered: of equal ids any one counts
        refused = self.table.update(new.dropDuplicates(["id"])).refused
        twice = good.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("error"))
        return marked.where("error is not null").select("id", "error").unionByName(refused.select("id", F.lit("taken").alias("error"))).unionByName(twice)

    def receive(self, now: int, most: int = 10) -> DataFrame:
        """Up to ``most`` visible messages, oldest first: (id, body, attributes, receipt, received).

        Messages that have come ``most_received`` times are moved aside instead.
        """
        rows = self.table.read().where((F.col("visible_at") <= now) & ~F.col("dead"))
        over = rows.where(F.col("received") >= self.most_received)
        self.table.update(over.select("id", F.col("version").alias("expected"), F.lit(True).alias("dead")))
        mine = uuid.uuid4().hex
        ready = rows.where(F.col("received") < self.most_received).orderBy("sent", "id").limit(most)
        claim = ready.select("id", F.col("version").alias("expected"), F.lit(now + self.visibility).cast("long").alias("visible_at"), F.concat(F.lit(mine + "/"), "id").alias("receipt"), (F.col("received") + 1).alias("received"))
        self.table.update(claim)
        # what another consumer has claimed in between has its receipt, not ours
        return self.table.read().where(F.col("receipt").startswith(mine)).select("id", "body", "attributes", "receipt", "received")

    def _by_receipt(self, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(current rows of valid receipts, receipts that are not valid any more)."""
        asked = receipts.select("id", F.col("receipt").alias("shown")).distinct()
        met = asked.join(self.table.read(), "id", "left").withColumn("valid", F.coalesce(F.col("receipt") == F.col("shown"), F.lit(False)))
        return met.where("valid"), met.where("not valid").select("id", F.col("shown").alias("receipt"))

    def acknowledge(self, receipts: DataFrame) -> DataFrame:
        """Removes the messages of (id, receipt); returns those whose receipt is not the message's last one."""
        valid, stale = self._by_receipt(receipts)
        stale = cut_lineage(stale)  # as it is now
        self.table.update(valid.select("id", F.col("version").alias("expected"), F.lit(True).alias("gone")))
        return stale

    def extend(self, receipts: DataFrame, now: int, seconds: int) -> int:
        """Hides the messages of valid receipts for so many seconds from now; their number."""
        valid, _ = self._by_receipt(receipts)
        return self.table.update(valid.select("id", F.col("version").alias("expected"), F.lit(now + seconds).cast("long").alias("visible_at"))).applied

    def dead_letters(self) -> DataFrame:
        return self.table.read().where("dead").select("id", "body", "attributes", "received")

    def depth(self, now: int) -> tuple[int, int, int]:
        """(visible, in flight, dead) messages."""
        r = self.table.read().agg(F.count_if((F.col("visible_at") <= now) & ~F.col("dead")).alias("v"), F.count_if((F.col("visible_at") > now) & ~F.col("dead")).alias("f"), F.count_if("dead").alias("d")).first()
        return r.v, r.f, r.d
