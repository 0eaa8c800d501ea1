"""Revisions of documents with their children, and the trash with its cascade."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators.revisions import Revisions
from leafmill.operators.trash import Graph
from leafmill.scratch import Tables


def docs(spark, rows):
    return spark.createDataFrame(rows, "id int, project string, sha string, name string")


def parts(spark, rows):
    return spark.createDataFrame(rows, "id int, n int, text string")


def test_a_document_that_comes_again_keeps_its_id(spark):
    kept = Revisions(spark, Tables(spark).path("r"), "id", ["project", "sha"], ["chapters"])
    kept.put(docs(spark, [(1, "p", "a", "x"), (2, "p", "b", "y"), (5, "p", "a", "twin")]), {"chapters": parts(spark, [(1, 0, "one"), (1, 1, "two"), (2, 0, "b"), (5, 0, "lost"), (9, 0, "nobody's")])})
    active = lambda name="chapters", **k: sorted(tuple(r) for r in kept.active(name, **k).select("id", "revision", "text" if name == "chapters" else "name").collect())
    first = active()
    assert first == [(1, 1, "one"), (1, 1, "two"), (2, 1, "b")] and active("documents") == [(1, 1, "x"), (2, 1, "y")]
    kept.put(docs(spark, [(70, "p", "a", "x2"), (80, "q", "a", "z")]), {"chapters": parts(spark, [(70, 0, "new"), (80, 0, "q")])})
    assert active() == [(1, 2, "new"), (2, 1, "b"), (80, 1, "q")]
    assert sorted((r["id"], r["text"]) for r in kept.snapshot("chapters", 1).collect()) == [(1, "one"), (1, "two")]
    assert active(version=1) == first
    kept.restore(spark.createDataFrame([(1, 1), (2, 7), (99, 1)], "id int, revision int"))
    assert active() == [(1, 3, "one"), (1, 3, "two"), (2, 1, "b"), (80, 1, "q")]
    assert active("documents") == [(1, 3, "x"), (2, 1, "y"), (80, 1, "z")]
    kept.put(docs(spark, [(3, "p", "b", "y")]), {"chapters": parts(spark, [])})  # a parse without chapters
    assert active() == [(1, 3, "one"), (1, 3, "two"), (80, 1, "q")]
    assert kept.put(docs(spark, []), {"chapters": parts(spark, [])}) == 5 and len(kept.history()) == 10


def test_every_restore_brings_the_revision_back(spark):
    rng = random.Random(4)
    kept = Revisions(spark, Tables(spark).path("r"), "id", ["sha"], ["chapters"])
    seen = {}
    for step in range(4):
        ids = rng.sample(range(6), 4)
        rows = [(i, n, f"{step}-{i}-{n}") for i in ids for n in range(rng.randint(0, 3))]
        kept.put(docs(spark, [(i, "p", str(i), "x") for i in ids]), {"chapters": parts(spark, rows)})
        for i in ids:
            seen.setdefault(i, []).append(sorted(t for k, _, t in rows if k == i))
    old = spark.createDataFrame([(i, 1) for i in seen], "id int, revision int")
    kept.restore(old)
    got = {}
    for r in kept.active("chapters").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert {i: sorted(t) for i, t in got.items()} == {i: revs[0] for i, revs in seen.items() if revs[0]}


GRAPH = Graph({"project": "pid", "chapter": "cid", "note": "nid"}, {"chapter": {"project": "project"}, "note": {"chapter": "chapter", "parent": "note"}})


@pytest.fixture
def data(spark):
    return {
        "project": spark.createDataFrame([(1,), (2,), (None,)], "pid int"),
        "chapter": spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", None)], "cid string, project int"),
        "note": spark.createDataFrame([(10, "a", None), (11, "c", 10), (12, "c", 11), (13, "c", None), (14, "d", 14)], "nid int, chapter string, parent int"),
    }


def ids(live):
    return {n: sorted(str(r[0]) for r in df.collect()) for n, df in live.items()}


def stamp(spark, rows):
    return spark.createDataFrame(rows, "id string, at string").select("id", F.col("at").cast("timestamp").alias("since"))


def test_trash_and_back(spark, data):
    tables, start = Tables(spark), ids(data)
    one = GRAPH.trashed(data, "project", stamp(spark, [("1", "2024-01-01"), ("7", "2024-01-01"), ("1", "2024-01-01")]), tables)
    assert one.columns == ["name", "id", "since", "root"] and one.count() == 6
    assert ids(GRAPH.live(data, one)) == {"project": ["2", "None"], "chapter": ["c", "d"], "note": ["13", "14"]}
    assert ids(GRAPH.live(data, GRAPH.restored(one, "project", stamp(spark, [("1", "2024-01-01")])))) == start
    both = one.unionByName(GRAPH.trashed(data, "chapter", stamp(spark, [("a", "2024-02-01")]), tables))
    back = GRAPH.restored(both, "project", stamp(spark, [("1", "2024-01-01")]))
    assert ids(GRAPH.live(data, back)) == {"project": ["1", "2", "None"], "chapter": ["b", "c", "d"], "note": ["13", "14"]}
    left, stones = GRAPH.purged(data, both, "2024-01-15")
    assert ids(left) == ids(GRAPH.live(data, one)) and stones.count() == 0
    loop = GRAPH.trashed(data, "note", stamp(spark, [("14", "2024-01-01")]), tables)  # a note that is its own parent
    assert ids(GRAPH.live(data, loop))["note"] == ["10", "11", "12", "13"]
    assert GRAPH.trashed(data, "project", stamp(spark, []), tables).count() == 0
