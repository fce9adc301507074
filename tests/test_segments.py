"""An index under changes scores as one built at once from the live documents."""

import random

import pytest
from pyspark.sql import functions as F
from tarn.operators import search as S
from tarn.operators.segments import SegmentedIndex
from tarn.sources.versioned import Conflict

TERMS = ["a", "b", "zz"]


def fields():
    return {"title": F.col("title"), "content": F.col("text")}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "doc long, title string, text string")


def scores(index):
    return {r.doc: round(r.score, 9) for r in S.lexical(index, TERMS, {"title": 3.0, "content": 1.0}, fuzzy=True).collect()}


def fresh(spark, tmp_path, rows, name):
    index = SegmentedIndex(spark, str(tmp_path / name))
    index.add(frame(spark, rows), "doc", fields())
    return index.view()


def texts(r, keys):
    word = lambda: r.choice(["a", "b", "c", "zz", "zy", "d e"])
    return {k: (word() if r.random() < 0.8 else None, " ".join(word() for _ in range(r.randrange(0, 8)))) for k in keys}


def test_changes_and_merges(spark, tmp_path):
    r = random.Random(3)
    index, live = SegmentedIndex(spark, str(tmp_path / "i")), {}
    for turn in range(5):
        batch = texts(r, r.sample(range(40), 12))
        done = index.add(frame(spark, batch), "doc", fields())
        assert (done.indexed, done.replaced) == (12, len(set(batch) & set(live)))
        live |= batch
    gone = [*list(live)[:5], 500]
    done = index.delete(spark.createDataFrame([(k,) for k in gone], "doc long"))
    assert (done.deleted, done.missing) == (5, 1)
    live = {k: v for k, v in live.items() if k not in gone}
    before = scores(index.view())
    assert before == scores(fresh(spark, tmp_path, live, "f")) and before
    n = index.segments()
    assert index.merge() < n and scores(index.view()) == before
    # after a merge nothing dead is left to read
    assert index.view().postings.select("doc").distinct().count() <= len(live)


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    index, other = SegmentedIndex(spark, str(tmp_path / "i")), SegmentedIndex(spark, str(tmp_path / "i"))
    r = random.Random(4)
    one, two = texts(r, range(6)), texts(r, range(4, 9))
    commit, raced = index.log.commit, []

    def slow(base, entry):
        if not raced:
            raced.append(other.add(frame(spark, two), "doc", fields()))
        return commit(base, entry)

    monkeypatch.setattr(index.log, "commit", slow)
    done = index.add(frame(spark, one), "doc", fields())
    # the other batch came first, so this one replaces two of its documents
    assert done.replaced == 2 and index.segments() == 2
    assert scores(index.view()) == scores(fresh(spark, tmp_path, two | one, "f"))
    monkeypatch.setattr(index.log, "commit", lambda *a: (_ for _ in ()).throw(Conflict("always")))
    with pytest.raises(Conflict):
        index.delete(frame(spark, one))


def test_empty_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    assert scores(index.view()) == {} and index.merge() == 0
    assert index.delete(spark.createDataFrame([(1,)], "doc long")).missing == 1
    assert index.add(frame(spark, {1: ("a", "")}), "doc", fields()).indexed == 1 and list(scores(index.view())) == [1]
