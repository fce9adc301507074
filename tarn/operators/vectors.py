"""Approximate nearest vectors: signs against fixed random planes, several tables, exact order of what they give."""

from __future__ import annotations

import math
import random
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.search import cosine

TABLES, BITS, REACH = 12, 8, 2
SEED = 7


def planes(dims: int, tables: int = TABLES, bits: int = BITS) -> list[list[list[float]]]:
    """Random directions by table and bit; the same for every build and query."""
    r = random.Random(SEED)
    return [[[r.gauss(0, 1) for _ in range(dims)] for _ in range(bits)] for _ in range(tables)]


def _signature(v: Column, table: list[list[float]]) -> Column:
    out = F.lit(0)
    for k, plane in enumerate(table):
        dot = F.aggregate(F.zip_with(v, F.array(*map(F.lit, plane)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        out = out + F.when(dot > 0, 1 << k).otherwise(0)
    return out


def signatures(vectors: DataFrame, key: str, column: str, dims: int) -> DataFrame:
    """(doc, signature per table): one row per vector, to be kept with the vectors."""
    made = [_signature(F.col(column), t).alias(f"s{i}") for i, t in enumerate(planes(dims))]
    return vectors.select(F.col(key).alias("doc"), F.col(column).alias("vector"), *made)


def near(signed: DataFrame, probe: list[float], k: int, reach: int = REACH) -> DataFrame:
    """(doc, score) of the k nearest among the vectors whose signature in some table is within ``reach`` flips of the probe's.

    The candidates' order is exact.  The filter is an expression over a few
    integers, so a scan reads the vectors of candidates' row groups only where
    the signatures are stored sorted; the recall is that of the tables.
    """
    tables = planes(len(probe))
    keep = F.lit(False)
    for i, table in enumerate(tables):
        mine = sum(1 << j for j, plane in enumerate(table) if math.fsum(a * b for a, b in zip(plane, probe, strict=True)) > 0)
        reached = [mine ^ sum(1 << b for b in flips) for n in range(reach + 1) for flips in combinations(range(BITS), n)]
        keep = keep | F.col(f"s{i}").isin(*reached)
    p = F.array(*[F.lit(float(x)) for x in probe])
    return signed.where(keep).select("doc", cosine(F.col("vector"), p).alias("score")).orderBy(F.desc("score"), "doc").limit(k)
