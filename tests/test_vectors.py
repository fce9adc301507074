"""The vector index: exact results, pruned lists, ties, odd rows, kept tables."""

import numpy as np
import pytest
from tarn.operators import ivf
from tarn.sources import shared


def made(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "id long, v array<float>")
    paths = {}
    for name, write in ivf.writers(df, "id", "v", 10).items():
        paths[name] = str(tmp_path / name)
        write(paths[name])
    return ivf.open_index(spark, paths)


def plain(rows, probe, k):
    x = ivf.unit(np.array([v for _, v in rows], dtype=np.float32).astype(np.float64))
    p = ivf.unit(np.array([probe], dtype=np.float64))[0]
    scored = sorted(((-round(float(s), 9), i) for (i, _), s in zip(rows, x @ p, strict=True)))
    return [i for _, i in scored[:k]]


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(3)
    middles = ivf.unit(r.normal(size=(12, 16)))
    return [(i, (middles[i % 12] + 0.05 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(1200)]


def test_few_lists_are_read(spark, tmp_path, clustered):
    """Vectors that lie in groups: the result is exact, and most codes and nearly all full vectors stay unread."""
    index = made(spark, tmp_path, clustered)
    for i in (0, 7, 500):
        found, read = ivf.exact(index, clustered[i][1], 10)
        assert [d for d, _ in found] == plain(clustered, clustered[i][1], 10) and abs(found[0][1] - 1) < 1e-6
        assert read["codes"] <= 0.35 * 1200 and read["vectors"] <= 0.15 * 1200
    found, read = ivf.near(index, clustered[3][1], 10)
    assert len({d for d, _ in found} & set(plain(clustered, clustered[3][1], 10))) >= 9
    assert read["codes"] <= 0.35 * 1200 and read["vectors"] == 30
    many = ivf.near_many(index, np.array([clustered[i][1] for i in (0, 5, 9)]), 10).collect()
    for n, i in enumerate((0, 5, 9)):
        assert len({r.doc for r in many if r.probe == n} & set(plain(clustered, clustered[i][1], 10))) >= 9
        assert max(r.codes for r in many if r.probe == n) <= 0.35 * 1200


def test_ties_zeros_and_nulls(spark, tmp_path, monkeypatch):
    """Thousands of equal vectors stay on the cluster; zero and null vectors are never hits."""
    monkeypatch.setattr(ivf, "MOST_KEYS", 20)
    r = np.random.default_rng(1)
    same = r.normal(size=8).astype(np.float32).tolist()
    rows = [(i, same) for i in range(300)] + [(1000 + i, r.normal(size=8).astype(np.float32).tolist()) for i in range(60)] + [(5000, [0.0] * 8)]
    index = made(spark, tmp_path, [*rows, (6000, None)])
    found, read = ivf.exact(index, same, 15)
    assert [d for d, _ in found] == list(range(15)) and read["vectors"] >= 300
    assert 5000 not in {d for d, _ in ivf.exact(index, same, 361)[0]}
    assert [d for d, _ in ivf.nearest(index, same, 15)] == list(range(15))


def test_small_and_empty(spark, tmp_path):
    index = made(spark, tmp_path / "one", [(4, [1.0, 2.0])])
    assert ivf.exact(index, [1.0, 2.0], 3)[0][0][0] == 4 and len(ivf.near(index, [1.0, 0.0], 3)[0]) == 1


def test_kept_tables_follow_their_source(spark, tmp_path):
    source = str(tmp_path / "s.parquet")
    written = []

    def build():
        return {"t": lambda path: (written.append(path), spark.range(len(written)).write.parquet(path))}

    spark.range(3).write.parquet(source)
    a = shared.kept_tables(spark, "test", source, build)
    assert shared.kept_tables(spark, "test", source, build) == a and len(written) == 1
    versions = {a["t"]}
    for n in (4, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        versions.add(shared.kept_tables(spark, "test", source, build)["t"])
    assert len(versions) == 3 and len(written) == 3
    # the last two versions stay
    assert sorted(shared.exists(spark, v) for v in versions) == [False, True, True]
