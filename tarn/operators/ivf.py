"""A vector index that skips data: inverted lists, one-byte codes with an error bound, and full vectors by key.

``build`` writes three tables.  *Codes* hold a vector's direction in one byte a
dimension and the length of what that leaves out, sorted by inverted list;
*vectors* hold the full ones, sorted by key; *lists* has a row per list with
its centroid (k-means over a bounded sample, fitted in Spark), its number of
vectors and the greatest angle of one to the centroid.

A search reads the codes of the lists in question and then the few full
vectors that may still be among the best, by key.  ``exact`` proves its result:
a list is left out only if no vector within its angle can reach the k-th best
score, and a vector only if its code's score and error cannot.  ``near`` reads
the ``reach`` nearest lists, a number that ``build`` measures on a bounded set
of probes against all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.search import cosine

#: Rows that k-means is fitted on, lists at most, and probes that ``reach`` is measured with.
SAMPLE, MOST_LISTS, PROBES = 200_000, 4096, 64
ITERATIONS, SEED = 12, 11
#: Tasks of a turn of k-means, lists of one block of its sums, and rows whose products with all centroids are held at once.
FIT_TASKS, BLOCK, ROWS_AT_ONCE = 16, 256, 1024
#: Points for each list that k-means chooses its beginnings from.
SPREAD = 4
#: Wanted share of the true neighbours in the lists that ``near`` reads.
RECALL = 0.95
#: Full vectors that are read for each one asked.
REFINE = 3
#: Up to so many keys are asked for as constants; beyond, codes and vectors are joined.
MOST_KEYS = 1000
#: Up to so many vectors one scan of them all is quicker than two reads.
SCANNED = 20_000


@dataclass
class Index:
    codes: DataFrame  # list, doc, code, scale, error
    vectors: DataFrame  # doc, vector
    centroids: np.ndarray  # a unit vector per list
    sizes: np.ndarray
    angles: np.ndarray
    reach: int


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest_list(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, cosine) of each unit vector's nearest centroid, some rows at once."""
    mine, cosines = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for k in range(0, len(x), ROWS_AT_ONCE):
        near = x[k : k + ROWS_AT_ONCE] @ centroids.T
        mine[k : k + ROWS_AT_ONCE] = best = near.argmax(axis=1)
        cosines[k : k + ROWS_AT_ONCE] = near[np.arange(len(near)), best]
    return mine, cosines


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The mean direction of each list's points, summed by blocks of lists; a list without points stays where it is."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims))
        for batch in batches:
            if len(batch):
                x = unit(_matrix(batch.column("vector")))
                np.add.at(total, _nearest_list(x, centroids)[0], x)
        blocks = [(i // BLOCK, total[i : i + BLOCK].tobytes()) for i in range(0, k, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype=np.float64) for b in table.column("part").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((k, dims))
    for r in points.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").collect():
        part = np.frombuffer(r.part, dtype=np.float64).reshape(-1, dims)
        out[r.block * BLOCK : r.block * BLOCK + len(part)] = part
    return unit(np.where(np.linalg.norm(out, axis=1, keepdims=True) > 0, out, centroids))


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k of the rows, each drawn in proportion to its distance from those before (k-means++)."""
    rng, picked = np.random.default_rng(SEED), [0]
    left = np.maximum(0, 1 - x @ x[0])
    while len(picked) < k and left.sum() > 1e-9:
        picked.append(int(rng.choice(len(x), p=left / left.sum())))
        left = np.minimum(left, np.maximum(0, 1 - x @ x[picked[-1]]))
    return x[picked]


def fit(vectors: DataFrame, column: str, rows: int) -> np.ndarray:
    """Centroids of about 2 sqrt(rows) lists, from ``SAMPLE`` rows at most: k-means by cosine that begins with distinct points.

    What comes to the driver in a turn has the size of the centroids.
    """
    k = max(1, min(MOST_LISTS, int(2 * math.sqrt(rows))))
    if k < 2:
        return np.eye(1, rows and len(vectors.select(column).first()[0]))
    some = vectors.where(F.exists(column, lambda x: x != 0))
    if rows > SAMPLE:
        some = some.sample(SAMPLE / rows, seed=SEED)
    # each point is needed once a turn
    points = some.select(F.col(column).cast("array<float>").alias("vector")).repartition(FIT_TASKS).persist()
    first = points.distinct().orderBy(F.xxhash64("vector", F.lit(SEED)), "vector").limit(SPREAD * k).collect()
    if not first:
        points.unpersist()
        return np.eye(1, len(vectors.where(F.col(column).isNotNull()).select(column).first()[0]))
    centroids = _spread(unit(np.array([r.vector for r in first], dtype=np.float64)), k)
    for _ in range(ITERATIONS):
        centroids = _moved(points, centroids)
    points.unpersist()
    return centroids


def coded(vectors: DataFrame, key: str, column: str, centroids: np.ndarray) -> DataFrame:
    """(list, doc, code, scale, error, angle, vector): what the tables are made of; null vectors are left out."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = unit(_matrix(batch.column("vector")))
            mine, cosines = _nearest_list(x, centroids)
            top = np.abs(x).max(axis=1)
            scale = np.where(top > 0, top, 1) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(x - code * scale[:, None], axis=1)
            angle = np.arccos(np.clip(cosines, -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine.astype(np.int32)), batch.column("doc"), lists, pa.array(scale), pa.array(error), pa.array(angle), batch.column("vector")],
                names=["list", "doc", "code", "scale", "error", "angle", "vector"],
            )

    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("doc"), F.col(column).cast("array<float>").alias("vector"))
    return rows.mapInArrow(run, f"list int, doc {kind}, code array<tinyint>, scale double, error double, angle double, vector array<float>")


def true_neighbours(vectors: DataFrame, column: str, probes: np.ndarray, k: int, keys: list[str]) -> DataFrame:
    """(probe, score, keys): the k best rows of each probe, by matrix products in blocks and a partial top-k per block."""
    fields = ", ".join(f"{n} {vectors.schema[n].dataType.simpleString()}" for n in keys)
    asked = unit(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            scores = asked @ unit(_matrix(batch.column(column))).T
            keep = min(k, scores.shape[1])
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            probe = np.repeat(np.arange(len(asked), dtype=np.int32), keep)
            at = pa.array(best.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(scores[probe, best.ravel()]), *(batch.column(n).take(at) for n in keys)], names=["probe", "score", *keys])

    found = vectors.select(column, *keys).mapInArrow(run, f"probe int, score double, {fields}")
    w = Window.partitionBy("probe").orderBy(F.desc("score"), *keys)
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def writers(vectors: DataFrame, key: str, column: str, k: int = 20) -> dict[str, Callable[[str], None]]:
    """Writers of the index's tables, each a function of its path, to be called in order."""
    spark = vectors.sparkSession
    held: dict[str, object] = {}

    def build(path: str) -> None:
        rows = vectors.where(F.col(column).isNotNull()).count()
        centroids = fit(vectors, column, rows)
        held["centroids"] = centroids
        # assigned once; both tables are read from here
        coded(vectors, key, column, centroids).write.parquet(path)
        held["all"] = spark.read.parquet(path)

    def codes(path: str) -> None:
        held["all"].drop("vector", "angle").repartitionByRange("list", "doc").sortWithinPartitions("list", "doc").write.parquet(path)

    def full(path: str) -> None:
        held["all"].select("doc", "vector").repartitionByRange("doc").sortWithinPartitions("doc").write.option("parquet.block.size", 8 << 20).parquet(path)

    def lists(path: str) -> None:
        centroids: np.ndarray = held["centroids"]
        per = {r.list: (r.n, r.a) for r in held["all"].groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect()}
        total = sum(n for n, _ in per.values())
        some = held["all"].select("vector").sample(min(1.0, 4 * PROBES / max(1, total)), seed=SEED).limit(PROBES).collect()
        reach = len(centroids)
        if some:
            probes = np.array([r.vector for r in some])
            order = np.argsort(np.argsort(-(unit(probes) @ centroids.T), axis=1), axis=1)
            found = true_neighbours(held["all"], "vector", probes, k, ["list", "doc"]).select("probe", "list").collect()
            ranks = np.sort([order[r.probe, r.list] for r in found])
            reach = int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1
        table = [(i, c.tolist(), *per.get(i, (0, 0.0)), reach) for i, c in enumerate(centroids)]
        spark.createDataFrame(table, "list int, centroid array<double>, n long, angle double, reach int").coalesce(1).write.parquet(path)

    return {"assigned": build, "codes": codes, "vectors": full, "lists": lists}


def open_index(spark: SparkSession, paths: dict[str, str]) -> Index:
    """The index at the paths; of its tables only ``lists`` is read, at most ``MOST_LISTS`` rows."""
    rows = spark.read.parquet(paths["lists"]).orderBy("list").collect()
    return Index(
        spark.read.parquet(paths["codes"]),
        spark.read.parquet(paths["vectors"]),
        np.array([r.centroid for r in rows]),
        np.array([r.n for r in rows]),
        np.array([r.angle for r in rows]),
        rows[0].reach if rows else 0,
    )


def _estimate(probe: np.ndarray) -> Column:
    p = F.array(*[F.lit(float(x)) for x in probe])
    return F.aggregate(F.zip_with("code", p, lambda c, x: c * x), F.lit(0.0), lambda s, x: s + x) * F.col("scale")


def _best_codes(index: Index, lists: list[int], probe: np.ndarray, m: int) -> list[tuple]:
    """(doc, estimate) of the m best codes in the lists."""
    rows = index.codes if len(lists) == len(index.sizes) else index.codes.where(F.col("list").isin(*lists))
    top = rows.select("doc", _estimate(probe).alias("e")).orderBy(F.desc("e"), "doc").limit(m)
    return [tuple(r) for r in top.collect()]


def _exact_scores(index: Index, docs: list, probe: np.ndarray) -> list[tuple[float, object]]:
    if not docs:
        return []
    p = F.array(*[F.lit(float(x)) for x in probe])
    rows = index.vectors.where(F.col("doc").isin(*docs)).select(cosine(F.col("vector"), p).alias("score"), "doc").collect()
    return sorted(((r.score, r.doc) for r in rows if r.score is not None), key=lambda r: (-round(r[0], 9), r[1]))


#: A code's direction is off by at most this, whatever the vector: half a step in each dimension of a unit vector.
def worst_error(dims: int) -> float:
    return math.sqrt(dims) / 254


def nearest(index: Index, probe: list[float], k: int) -> list[tuple]:
    """[(doc, score)] of the k nearest by cosine: by one scan of few vectors, else by ``exact``."""
    if index.sizes.sum() > SCANNED:
        return exact(index, probe, k)[0]
    p = F.array(*[F.lit(float(x)) for x in probe])
    scored = index.vectors.select("doc", cosine(F.col("vector"), p).alias("score")).where("score is not null")
    return [tuple(r) for r in scored.orderBy(F.desc(F.round("score", 9)), "doc").limit(k).collect()]


def exact(index: Index, probe: list[float], k: int) -> tuple[list[tuple], dict[str, int]]:
    """([(doc, score)] of the k nearest by cosine, rows read): proven, not estimated.

    The best codes of the ``reach`` nearest lists give a k-th best score.  If
    the last code taken cannot reach it, those lists are done.  Then all other
    lists with a vector that could reach it are read, and of their codes those
    whose estimate and error could.  No more than a few times k rows come to
    the driver, however many vectors tie.
    """
    p = unit(np.array([probe], dtype=np.float64))[0]
    near = index.centroids @ p
    order = np.argsort(-near)
    most = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - index.angles))
    first = [int(i) for i in order[: index.reach] if index.sizes[i]]
    top = _best_codes(index, first, p, REFINE * k) if first else []
    best = _exact_scores(index, [d for d, *_ in top], p)[:k]
    read = {"codes": int(index.sizes[first].sum()), "vectors": len(top)}
    bar = best[k - 1][0] if len(best) == k else -2.0
    left = [int(i) for i in order[index.reach :] if index.sizes[i] and most[i] >= bar - 1e-9]
    if len(top) == REFINE * k and top[-1][1] + worst_error(len(p)) >= bar - 1e-9:
        left += first
    if left:
        read["codes"] += int(index.sizes[left].sum())
        rows = index.codes if len(left) == len(index.sizes) else index.codes.where(F.col("list").isin(*left))
        few = rows.where(_estimate(p) + F.col("error") >= bar - 1e-9).select("doc")
        docs = [r.doc for r in few.limit(MOST_KEYS + 1).collect()]
        if len(docs) <= MOST_KEYS:
            more = _exact_scores(index, docs, p)
        else:
            scored = index.vectors.join(few, "doc", "left_semi").select("doc", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in p])).alias("score"))
            more = [(r.score, r.doc) for r in scored.where("score is not null").orderBy(F.desc(F.round("score", 9)), "doc").limit(k).collect()]
        read["vectors"] += len(docs) if len(docs) <= MOST_KEYS else few.count()
        every = {d: s for s, d in [*best, *more]}
        best = sorted(((s, d) for d, s in every.items()), key=lambda r: (-round(r[0], 9), r[1]))[:k]
    return [(d, s) for s, d in best], read


def near(index: Index, probe: list[float], k: int, reach: int | None = None) -> tuple[list[tuple], dict[str, int]]:
    """([(doc, score)], rows read) among the ``reach`` nearest lists, by default the measured number."""
    p = unit(np.array([probe], dtype=np.float64))[0]
    lists = [int(i) for i in np.argsort(-(index.centroids @ p))[: reach or index.reach] if index.sizes[i]]
    top = _best_codes(index, lists, p, REFINE * k) if lists else []
    best = _exact_scores(index, [d for d, *_ in top], p)[:k]
    return [(d, s) for s, d in best], {"codes": int(index.sizes[lists].sum()), "vectors": len(top)}


def near_many(index: Index, probes: np.ndarray, k: int, reach: int | None = None) -> DataFrame:
    """(probe, doc, score, codes): ``near`` for a bounded set of probes in one pass over the codes and one over the vectors.

    ``codes`` is the number of codes a probe's lists hold.
    """
    asked = unit(np.asarray(probes, dtype=np.float64))
    chosen = np.zeros((len(asked), len(index.sizes)), dtype=bool)
    np.put_along_axis(chosen, np.argsort(-(asked @ index.centroids.T), axis=1)[:, : reach or index.reach], True, axis=1)
    m = REFINE * k
    kind = index.codes.schema["doc"].dataType.simpleString()

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("list").to_numpy()
            scores = asked @ (_matrix(batch.column("code")) * batch.column("scale").to_numpy()[:, None]).T
            scores[~chosen[:, lists]] = -np.inf
            keep = min(m, len(batch))
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            probe = np.repeat(np.arange(len(asked), dtype=np.int32), keep)
            value = scores[probe, best.ravel()]
            there = np.isfinite(value)
            yield pa.RecordBatch.from_arrays([pa.array(probe[there]), batch.column("doc").take(pa.array(best.ravel()[there])), pa.array(value[there])], names=["probe", "doc", "e"])

    rows = index.codes.select("list", "doc", "code", "scale").mapInArrow(estimate, f"probe int, doc {kind}, e double")
    w = Window.partitionBy("probe").orderBy(F.desc("e"), "doc")
    few = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= m).select("probe", "doc")
    table = pa.table({"probe": pa.array(np.arange(len(asked), dtype=np.int32)), "p": pa.array(asked.tolist(), pa.list_(pa.float64())), "codes": pa.array(chosen @ index.sizes)})
    scored = few.join(index.vectors, "doc").join(F.broadcast(rows.sparkSession.createDataFrame(table)), "probe").select("probe", "doc", cosine(F.col("vector"), F.col("p")).alias("score"), "codes")
    best = Window.partitionBy("probe").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")
