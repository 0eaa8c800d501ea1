"""All listings of projects at once, against sorts; large projects go by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import review
from leafmill.scratch import dealt
from leafmill.sources import exports


@pytest.mark.parametrize("most", [10**6, 12])
def test_every_listing_of_every_project(spark, monkeypatch, most):
    monkeypatch.setattr(review, "PROJECT_ROWS", most)
    rng = random.Random(4)
    rows = [(rng.choice(["big"] * 4 + ["a", "b", None]), i, rng.choice([None, 1, 2, 3]), rng.choice(["x", "y"])) for i in range(60)]
    at, kind = F.col("at"), F.col("kind")
    columns = {"imported_at": at, "updated_at": at, "created_at": at + 0, "trashed_at": at, "kind": kind, "chapter_plan_id": F.col("n") % 7, "revision": at, "ordinal": at, "id": F.col("n")}
    df = spark.createDataFrame(rows, "p string, n long, at int, kind string")
    got = review.all_listed(df, "p", columns, "n")
    assert got.columns == ["p", "n", "listing", "place"] and dict(got.dtypes)["place"] == "bigint"
    late = lambda r: (r[2] is None, -(r[2] or 0))  # noqa: E731  the latest first, nulls last
    early = lambda r: (r[2] is not None, r[2] or 0)
    key = {"checkpoints": lambda r: (*late(r), -r[1]), "drafts": lambda r: (*late(r), r[1] % 7, r[1]), "bible": lambda r: (r[3], r[1]), "analyses": lambda r: (*early(r), r[1])}
    key |= dict.fromkeys(("tasks", "reports", "snapshots"), key["checkpoints"]) | {"chapters": key["analyses"]}
    wanted = set()
    for name in review.LISTINGS:
        order = sorted(rows, key=key.get(name, lambda r: (*late(r), r[1])))
        for p in {r[0] for r in rows}:
            wanted |= {(p, r[1], name, i) for i, r in enumerate((r for r in order if r[0] == p), 1)}
    assert {tuple(r) for r in got.collect()} == wanted and got.count() == 60 * len(review.LISTINGS)


def test_rows_are_dealt_to_more_partitions_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr("leafmill.scratch.ROWS", 10)
    assert dealt(spark.range(95), "id").rdd.getNumPartitions() == 10
    assert dealt(spark.range(0), "id").count() == 0


def test_a_bundle_is_restored_in_more_tasks_as_it_grows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("leafmill.scratch.ROWS", 10)
    chapters = [(i, i % 3) for i in range(8)]  # project 2 is not in the bundle, chapter 9 neither
    versions = [(f"v{i}", rng, 100 - i) for i, rng in enumerate([*range(8), 9] * 11)]
    bundle = {"projects": spark.createDataFrame([(0,), (1,)], "project_id long"), "chapters": spark.createDataFrame(chapters, "chapter_id long, project_id long"), "versions": spark.createDataFrame(versions, "version_id string, chapter_id long, revision int")}
    exports.write_bundle(bundle, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = exports.restored(exports.read_bundle(spark, str(tmp_path / "b")), "-x")
        assert back["versions"].rdd.getNumPartitions() == 10
        got = {tuple(r) for r in back["versions"].select("version_id", "chapter_id", "revision").collect()}
        assert {tuple(r) for r in back["chapters"].select("chapter_id", "project_id").collect()} == {(f"{c}-x", f"{p}-x") for c, p in chapters if p < 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wanted = set()
    for c in range(8):
        wanted |= {(f"{v}-x", f"{c}-x", n) for n, (_, v) in enumerate(sorted((r, v) for v, own, r in versions if own == c), 1)}
    assert got == wanted
