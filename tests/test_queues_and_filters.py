"""Queues with receipts and redelivery, growing filters, filters of generations in a stream."""

import random

from pyspark.sql import functions as F
from tarn.operators import bloom, growing
from tarn.sources.queues import MOST_BYTES, Queue


def ids(df):
    return sorted(r.id for r in df.collect())


def test_queue(spark, tmp_path):
    q = Queue(spark, str(tmp_path / "q"), visibility=30, most_received=2, buckets=2)
    rows = [("a", "1", {"k": "v"}), ("b", "2", {}), ("c", "3", {}), ("empty", "", {}), ("long", "x" * (MOST_BYTES + 1), {})]
    failed = q.send(spark.createDataFrame(rows, "id string, body string, attributes map<string,string>"), 100)
    assert sorted((r.id, r.error) for r in failed.collect()) == [("empty", "empty"), ("long", "too long")]
    assert sorted((r.id, r.error) for r in q.send(spark.createDataFrame([("a", "again")], "id string, body string"), 100).collect()) == [("a", "taken")]
    got = q.receive(100, 2)
    first = got.collect()
    assert [(r.id, r.attributes, r.received) for r in sorted(first)] == [("a", {"k": "v"}, 1), ("b", {}, 1)] and q.depth(100) == (1, 2, 0)
    # hidden from another consumer
    assert ids(Queue(spark, str(tmp_path / "q"), 30, 2).receive(101, 10)) == ["c"]
    shown = spark.createDataFrame([(r.id, r.receipt) for r in first], "id string, receipt string")
    assert q.acknowledge(shown.where("id = 'a'")).count() == 0
    assert q.extend(shown.where("id = 'b'"), 101, 100) == 1
    assert ids(q.receive(135, 10)) == ["c"]  # not acknowledged in time; b is hidden for longer
    # the receipt of the first delivery is of no use after the second
    again = q.receive(300, 10).collect()
    assert [(r.id, r.received) for r in again] == [("b", 2)]
    assert [r.id for r in q.acknowledge(shown.where("id = 'b'")).collect()] == ["b"]
    # c has come twice and is moved aside
    assert [(r.id, r.received) for r in q.dead_letters().collect()] == [("c", 2)]
    now = spark.createDataFrame([(r.id, r.receipt) for r in again], "id string, receipt string")
    assert q.acknowledge(now).count() == 0 and q.depth(1000) == (0, 0, 1)


def test_growing_filter(spark, tmp_path):
    f = growing.GrowingFilter(spark, str(tmp_path / "f"), 30, 0.001)
    values = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("v"))
    added = 0
    for k in range(4):
        added += f.add(values(50 * k, 50 * k + 60), "v")
    layers = f.layers()
    assert [x["items"] for x in layers] == [30 * 4**k for k in range(len(layers))] and len(layers) > 1
    assert all(x["count"] <= x["items"] for x in layers) and sum(x["count"] for x in layers) == added
    assert abs(layers[0]["error"] - 0.0009) < 1e-12 and abs(layers[1]["error"] - 0.00081) < 1e-12
    # nothing is lost, repeats are not added, and hardly another value is taken for present
    assert added >= 208 and f.probe(values(0, 210), "v").where("not maybe").count() == 0
    assert f.add(values(0, 210), "v") == 0
    assert f.probe(values(10_000, 12_000), "v").where("maybe").count() <= 12
    one = bloom.build(values(0, 210), "v", 210, 0.001)
    assert bloom.probe(values(0, 210), "v", one, 210, 0.001).where("not maybe").count() == 0
    for k in range(growing.MOST_PARTS + 2):
        f.add(values(1000 + k, 1001 + k), "v")
    assert max(len(x["parts"]) for x in f.layers()) <= growing.MOST_PARTS
    assert f.probe(values(1000, 1010), "v").where("not maybe").count() == 0 and f.probe(values(0, 0), "v").count() == 0


def test_generations_in_a_stream(spark, tmp_path):
    """Over two batches; a value is forgotten after three generations, never before."""
    r = random.Random(2)
    rows = sorted((r.randrange(0, 200), k, r.choice("abcdef")) for k in range(120)) + [(1000, 500, "a"), (1001, 501, "a")]
    schema = "at long, seq long, value string"
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = growing.generations_stream(stream, 10, shards=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {x.seq: x.seen for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, last = {}, {}
    for at, seq, v in rows:
        want[seq] = v in last and last[v] >= at // 10 - 2
        last[v] = at // 10
    # the shard's clock moves with its own values, so a quiet shard may remember for longer, never for less
    assert set(got) == set(want) and all(got[s] for s in want if want[s])
    assert sum(got[s] != want[s] for s in want) == 0
