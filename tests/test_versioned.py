"""Commit logs, conditional updates and two writers at once."""

import threading

import pytest
from pyspark.sql import functions as F
from tarn.sources.versioned import CommitLog, Conflict, VersionedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i}", i * 1.0) for i in range(20)], "id long, state string, score double")
    return VersionedTable.create(df, str(tmp_path / "t"), "id", 4)


def change(spark, data, schema="id long, expected long, state string"):
    return spark.createDataFrame(data, schema)


def test_log_numbers_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() == (-1, None) and log.commit(-1, {"a": 1}) == 0
    wins = []

    def race(n):
        try:
            wins.append((n, log.commit(0, {"by": n})))
        except Conflict:
            wins.append((n, None))

    threads = [threading.Thread(target=race, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winner = [n for n, v in wins if v == 1]
    assert len(winner) == 1 and log.latest() == (1, {"by": winner[0]})


def test_expected_versions(spark, table):
    out = table.update(change(spark, [(1, 1, "x"), (2, 7, "x"), (99, None, "new"), (3, None, "there"), (98, 1, "gone")]))
    assert out.applied == 2 and {r.id for r in out.refused.collect()} == {2, 3, 98}
    now = {r.id: (r.state, r.score, r.version) for r in table.read().collect()}
    assert len(now) == 21 and now[1] == ("x", 1.0, 2) and now[2] == ("s2", 2.0, 1) and now[99] == ("new", None, 1) and now[3] == ("s3", 3.0, 1)
    # older versions are still there
    assert {r.id: r.state for r in table.read(0).collect()}[1] == "s1"


def test_removed_columns_and_repeated_keys(spark, table):
    data = [(4, 1, "b", ["score"]), (5, 1, "z", None), (5, 1, "a", None)]
    out = table.update(change(spark, data, "id long, expected long, state string, removes array<string>"))
    now = {r.id: (r.state, r.score, r.version) for r in table.read().collect()}
    assert now[4] == ("b", None, 2) and now[5] == ("a", 5.0, 2)
    assert out.applied == 2 and [r.state for r in out.refused.collect()] == ["z"]


def test_two_writers(spark, table):
    """Both have read version 1 of row 6; one wins, the other is refused and succeeds with what it reads then."""
    other = VersionedTable(spark, table.path)
    seen = []
    out = table.update(change(spark, [(6, 1, "mine"), (7, 1, "mine")]), lambda: seen.append(other.update(change(spark, [(6, 1, "theirs")]))))
    assert seen[0].applied == 1 and out.applied == 1 and {r.id for r in out.refused.collect()} == {6}
    now = {r.id: (r.state, r.version) for r in table.read().collect()}
    assert now[6] == ("theirs", 2) and now[7] == ("mine", 2)
    again = table.update(out.refused.drop("expected").join(table.read().select("id", F.col("version").alias("expected")), "id").select("id", "expected", "state"))
    assert again.applied == 1 and {r.id: (r.state, r.version) for r in table.read().collect()}[6] == ("mine", 3)


def test_writers_of_other_rows_do_not_wait(spark, tmp_path):
    df = spark.range(40).select(F.col("id"), F.lit("a").alias("state"))
    table = VersionedTable.create(df, str(tmp_path / "t"), "id", 8)
    bucket = {r.id: r.b for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    one, two = 0, next(k for k, b in bucket.items() if b != bucket[0])
    out = table.update(change(spark, [(one, 1, "x")]), lambda: VersionedTable(spark, table.path).update(change(spark, [(two, 1, "y")])))
    assert out.applied == 1 and out.version == 2
    now = {r.id: r.state for r in table.read().collect()}
    assert now[one] == "x" and now[two] == "y" and len(now) == 40
    table.vacuum(1)
    assert {r.id: r.state for r in table.read().collect()} == now


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "id long, state string")
    table = VersionedTable.create(df, str(tmp_path / "t"), "id", 2)
    assert table.read().count() == 0
    assert table.update(change(spark, [])).applied == 0 and table.update(change(spark, [(1, None, "a")])).applied == 1
    assert rows(table.read()) == [(1, "a", 1)]
