"""Requests of a key inside a sliding window, when the next one is allowed, and what came before each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 60


def in_window(events: DataFrame, key: str, second: str, seconds: int = WINDOW) -> DataFrame:
    """``events`` with ``in_window``: requests of the key in the ``seconds`` up to and with the event's own second.

    Requests are counted per key and second first, map-side, so that the window
    over a hot key is as long as its seconds, and the counts come back to the
    events by key and second.
    """
    per = events.groupBy(F.col(key).alias("__k"), F.col(second).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__k").orderBy("__s").rangeBetween(-(seconds - 1), 0)
    sums = per.select("__k", "__s", F.sum("__n").over(w).alias("in_window"))
    return events.join(sums, (F.col(key) == F.col("__k")) & (F.col(second) == F.col("__s"))).drop("__k", "__s")


def next_allowed(events: DataFrame, key: str, second: str, limit: Column | int = 1, seconds: int = WINDOW) -> DataFrame:
    """``events`` with ``next_allowed``: the next whole second where the window holds more than ``limit``, else the event's own."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    return in_window(events, key, second, seconds).withColumn("next_allowed", F.when(F.col("in_window") > most, F.col(second) + 1).otherwise(F.col(second)))


def previous(events: DataFrame, key: str, micros: str, order: str, value: Column, name: str, seconds: int = 3600) -> DataFrame:
    """``events`` with ``name``: ``value`` of the key's event before, by time and ``order``; null for its first one.

    Events of one key and hour are in order within their task; the first of an
    hour takes the last of the hours before, which a window over one row per
    key and hour hands on.  So no task has all events of a hot key.
    """
    rows = events.withColumns({"__p": F.expr(f"{micros} div {seconds * 1_000_000}"), "__v": F.struct(value.alias("v"))})
    near = Window.partitionBy(key, "__p").orderBy(micros, order)
    inner = rows.withColumn("__inner", F.lag("__v").over(near))
    last = rows.groupBy(F.col(key).alias("__k"), F.col("__p").alias("__q")).agg(F.max_by("__v", F.struct(micros, order)).alias("__last"))
    before = last.select("__k", "__q", F.lag("__last").over(Window.partitionBy("__k").orderBy("__q")).alias("__before"))
    met = inner.join(before, (F.col(key) == F.col("__k")) & (F.col("__p") == F.col("__q")))
    return met.withColumn(name, F.coalesce("__inner", "__before")["v"]).drop("__p", "__v", "__inner", "__k", "__q", "__before")
