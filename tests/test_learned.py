"""Learnt vectors against a plain decomposition, and against hashing by the labels of neighbours."""

import random

import numpy as np
from pyspark.sql import functions as F
from tarn.operators import learned
from tarn.operators.embedding import embed, hashed


def made(seed, topics, each):
    """Texts of topics with words of their own beside common ones; labels are the topics."""
    r = random.Random(seed)
    own = [[f"t{k}w{j}" for j in range(120)] for k in range(topics)]
    common = [f"c{j}" for j in range(400)]
    return [(i, " ".join([r.choice(own[i % topics]) for _ in range(12)] + [r.choice(common) for _ in range(60)]), i % topics) for i in range(topics * each)]


def test_directions_are_the_leading_ones(spark):
    rows = made(1, 4, 40)
    df = spark.createDataFrame(rows, "id long, text string, label int").repartition(3)
    model = learned.fit(df, dims=4, n=512, passes=4)
    a = np.zeros((len(rows), 512))
    at, ids, values = learned.features([t for _, t, _ in rows], model.weights)
    a[at, ids] = values
    best = np.linalg.svd(a, full_matrices=False)
    kept = np.linalg.norm(a @ model.directions) ** 2
    assert kept >= 0.97 * (best[1][:4] ** 2).sum() and np.allclose(model.directions.T @ model.directions, np.eye(4), atol=1e-8)
    counts = (a > 0).sum(axis=0)
    assert np.allclose(model.weights, np.where(counts > 0, np.log((1 + len(rows)) / (1 + counts)), 0))


def share(x, labels, k=10):
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return (np.array(labels)[top] == np.array(labels)[:, None]).mean()


def test_neighbours_by_label(spark):
    """Texts of a topic are near each other, far more often than by hashing into as many dimensions."""
    rows = made(2, 10, 30)
    df = spark.createDataFrame(rows, "id long, text string, label int").repartition(4)
    model = learned.fit(df, dims=16)
    texts, labels = [t for _, t, _ in rows], [k for *_, k in rows]
    a = np.zeros((len(rows), learned.FEATURES))
    at, ids, values = learned.features(texts, model.weights)
    a[at, ids] = values
    exact = a @ np.linalg.svd(a, full_matrices=False)[2][:16].T
    mine = share(model(texts), labels)
    assert mine > share(hashed(texts, 16), labels) + 0.3 and mine > share(exact, labels) - 0.1
    vectors = {r.id: np.array(r.v) for r in df.select("id", embed(F.col("text"), model).alias("v")).collect()}
    assert np.allclose(vectors[7], model([texts[7]])[0], atol=1e-6)


def test_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("one two",), ("one two",)], "text string")
    model = learned.fit(df, dims=2, n=64)
    got = model(["", "one two", "never seen"])
    assert got.shape == (3, 2) and not got[0].any() and np.isfinite(got).all()
    assert learned.fit(df.limit(0), dims=2, n=64)(["a"]).shape == (1, 2)
