"""Bloom filters as tables of bitmaps: built, merged and probed by built-in functions.

A filter is (bucket, bitmap) rows of 32768 bits each, so building combines
map-side and no task holds the whole filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_BITS = 32_768


def sizes(items: int, error: float) -> tuple[int, int]:
    """(hash functions, bits per hash function) for so many items at an error rate."""
    k = math.ceil(math.log2(1 / error))
    return k, math.ceil(items * abs(math.log(error)) / (k * math.log(2) ** 2))


def positions(value: Column, items: int, error: float) -> Column:
    """One bit position in each of the k slices."""
    k, m = sizes(items, error)
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(i)), F.lit(m)) + i * m for i in range(k)])


def digest_positions(key: Column, capacity: int, hashes: int = 3) -> Column:
    """Positions by the salted digest rule: the 128-bit md5 of ``key:i`` modulo eight times the capacity."""
    m = capacity * 8
    if m >= 1 << 31:
        raise ValueError("capacity too large for 64-bit arithmetic")
    out = []
    for i in range(hashes):
        hexed = F.md5(F.concat(key, F.lit(f":{i}")))
        r = F.lit(0).cast("long")
        for w in range(4):
            word = F.conv(F.substring(hexed, 8 * w + 1, 8), 16, 10).cast("long")
            r = F.pmod(r * ((1 << 32) % m) + word, F.lit(m))
        out.append(r)
    return F.array(*out)


class CapacityError(ValueError):
    """More values than a filter was made for."""


def room(df: DataFrame, column: str) -> int:
    """Items that a filter of the column needs: its distinct values, one at least."""
    return max(1, df.select(column).where(F.col(column).isNotNull()).distinct().count())


def build(df: DataFrame, column: str, items: int, error: float) -> DataFrame:
    at = df.select(F.explode(positions(F.col(column), items, error)).alias("p")).where("p is not null")
    return at.groupBy(F.expr(f"p div {BUCKET_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % BUCKET_BITS).alias("bitmap"))


def build_checked(df: DataFrame, column: str, items: int, error: float) -> DataFrame:
    """``build``, but an error where there are more distinct values than ``items``."""
    many = room(df, column)
    if many > items:
        raise CapacityError(f"{many} values for a filter of {items}")
    return build(df, column, items, error)


def layer_sizes(values: int, initial: int, error: float, growth: int = 2, ratio: float = 0.9) -> list[tuple[int, float]]:
    """(items, error) of the layers that hold so many values: each ``growth`` times the one before, with a smaller error.

    The first error is a share of the asked one, so that all together stay below it.
    """
    out, items, e = [], initial, error * (1 - ratio)
    while not out or sum(n for n, _ in out) < values:
        out.append((items, e))
        items, e = items * growth, e * ratio
    return out


def build_layers(df: DataFrame, column: str, initial: int, error: float) -> list[tuple[DataFrame, int, float]]:
    """A filter that grows: values dealt to the layers by a hash, in proportion to their sizes, so that none overflows in the mean."""
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    sizes_ = layer_sizes(values.count(), initial, error)
    total = sum(n for n, _ in sizes_)
    place = F.pmod(F.xxhash64("v", F.lit(-1)), F.lit(total))
    out, base = [], 0
    for n, e in sizes_:
        out.append((build(values.where((place >= base) & (place < base + n)), "v", n, e), n, e))
        base += n
    return out


def probe_layers(df: DataFrame, column: str, layers: list[tuple[DataFrame, int, float]]) -> DataFrame:
    """Distinct values with ``maybe``: whether any layer says so."""
    found = None
    for f, n, e in layers:
        one = probe(df, column, f, n, e)
        found = one if found is None else found.unionAll(one)
    return found.groupBy(column).agg(F.bool_or("maybe").alias("maybe"))


def save(filter_: DataFrame, path: str, items: int, error: float) -> None:
    """The filter as a table that knows what it was made for."""
    filter_.withColumns({"items": F.lit(items).cast("long"), "error": F.lit(error)}).write.parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, float]:
    """(filter, items, error) as saved; an error for a folder that holds no filter."""
    df = spark.read.parquet(path)
    if set(df.columns) != {"bucket", "bitmap", "items", "error"}:
        raise ValueError(f"no filter at {path}")
    row = df.select("items", "error").first()
    if row is None:
        raise ValueError(f"an empty filter at {path}")
    return df.select("bucket", "bitmap"), row["items"], row["error"]


def union(*filters: DataFrame) -> DataFrame:
    rows = filters[0]
    for f in filters[1:]:
        rows = rows.unionAll(f)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    words = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BITS // 32 - 1)), lambda i: F.conv(F.hex(F.substring(c, i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    both = a.join(b.withColumnRenamed("bitmap", "other"), "bucket")
    merged = F.zip_with(words(F.col("bitmap")), words(F.col("other")), lambda x, y: F.lpad(F.hex(x.bitwiseAND(y)), 8, "0"))
    return both.select("bucket", F.unhex(F.array_join(merged, "")).alias("bitmap"))


def probe(df: DataFrame, column: str, filter_: DataFrame, items: int, error: float) -> DataFrame:
    """Distinct values of ``column`` with ``maybe``: false means surely absent."""
    k, _ = sizes(items, error)
    at = df.select(F.col(column).alias("v")).where("v is not null").distinct().select("v", F.explode(positions(F.col("v"), items, error)).alias("p"))
    met = at.withColumn("bucket", F.expr(f"p div {BUCKET_BITS}")).join(filter_, "bucket", "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.expr(f"cast((p % {BUCKET_BITS}) div 8 as int)") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.expr("cast(pow(2, p % 8) as int)")) != 0, F.lit(False))
    return met.groupBy("v").agg((F.count_if(bit) == k).alias("maybe")).withColumnRenamed("v", column)
