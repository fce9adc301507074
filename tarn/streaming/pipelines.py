"""Structured Streaming forms: ingest with retries and dead letters, windowed rates, time-bounded dedup, leases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarn.operators.leases import fold_stream
from tarn.sources.stores import decode

MAX_RETRIES = 3


def ingest(raw: DataFrame, schema: StructType, process: Callable[[DataFrame], DataFrame], good: str, dead: str, checkpoint: str, column: str = "value") -> StreamingQuery:
    """Messages to index documents: malformed ones and those out of retries go to the dead-letter folder.

    Each batch writes to a folder of its own number, so a batch that runs again
    after a failure overwrites what it left.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        parsed, bad = decode(df, column, schema)
        if "retry_count" in schema.fieldNames():
            over = parsed.where(F.col("retry_count") >= MAX_RETRIES)
            bad = bad.unionByName(over.select(F.to_json(F.struct(*over.columns)).alias("message")))
            parsed = parsed.where(F.coalesce("retry_count", F.lit(0)) < MAX_RETRIES)
        process(parsed).write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        df.unpersist()

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "60 seconds", slide: str = "1 second", late: str = "2 minutes") -> DataFrame:
    """Requests per key and sliding window, late rows up to ``late``."""
    return events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).groupBy(F.window("__at", size, slide), F.col(key)).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).groupBy(F.session_window("__at", gap), F.col(key)).agg(F.count(F.lit(1)).alias("n"))


def rotating_dedup(events: DataFrame, at: str, key: str, horizon: str = "1 hour") -> DataFrame:
    """First of equal keys within the horizon; state older than that is dropped."""
    return events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", horizon).dropDuplicatesWithinWatermark([key]).drop("__at")


def generations(events: DataFrame, at: str, key: str, seconds: int, kept: int = 3) -> DataFrame:
    """``events`` with ``seen``: whether the key came before in this or the last ``kept`` - 1 generations of so many seconds.

    A batch form of rotating filters: each generation holds its own keys, and
    the oldest is cleared when a new one begins.
    """
    g = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds).cast("long")
    rows = events.withColumn("__g", g)
    firsts = rows.groupBy(F.col(key).alias("__k"), F.col("__g").alias("__h")).agg(F.min(at).alias("__first"))
    # one row per key and generation that still knows it
    known = firsts.withColumn("__g", F.explode(F.sequence(F.col("__h"), F.col("__h") + (kept - 1)))).groupBy("__k", "__g").agg(F.min("__first").alias("__first"))
    met = rows.join(known, (F.col(key) == F.col("__k")) & (rows["__g"] == known["__g"]), "left")
    return met.select(*[F.col(c) for c in events.columns], F.coalesce(F.col("__first") < F.col(at), F.lit(False)).alias("seen"))


def lease_states(events: DataFrame) -> DataFrame:
    return fold_stream(events)
