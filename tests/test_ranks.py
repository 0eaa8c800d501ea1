"""Places by group over ranges, against a sort."""

import random

from pyspark.sql import functions as F

from leafmill.operators import review
from leafmill.ranks import ranked
from leafmill.scratch import Tables


def test_places_of_groups_that_span_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["big"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, y int").repartition(7)
    got = ranked(df, [F.col("x").desc(), F.col("y").asc()], "place", Tables(spark), ["g"])
    assert got.columns == ["g", "x", "y", "place"]
    wanted = set()
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        wanted |= {(*r, n) for n, r in enumerate(order, 1)}
    assert {tuple(r) for r in got.collect()} == wanted
    spread = got.where("g = 'big'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 1 and ranked(df.limit(0), [F.col("x").asc()], "n", Tables(spark), ["g"]).count() == 0


def test_names_in_a_languages_order(spark):
    names = ["周屿", "阿", "林栀", "ea", "Ea", "éa", "n", "ñ", "林栀"]
    got = review.by_name(spark.createDataFrame([("b", n) for n in names] + [("c", "阿")], "book string, name string"), "book", "name", "zh").collect()
    order = [r["name"] for r in sorted((r for r in got if r["book"] == "b"), key=lambda r: r["place"])]
    assert order.index("阿") < order.index("林栀") < order.index("周屿") and len(order) == len(names)
    assert [r["place"] for r in got if r["book"] == "c"] == [1]


def test_latest_reports(spark):
    rows = spark.createDataFrame([("p", 1, 5, "a", "x"), ("p", 1, 5, "b", "y"), ("p", 1, 4, "z", "w"), ("p", 2, 1, "a", None)], "project_id string, chapter_plan_id int, created_at int, id string, status string")
    got = review.latest_reports(rows)
    assert got.columns == rows.columns
    assert {tuple(r) for r in got.collect()} == {("p", 1, 5, "b", "y"), ("p", 2, 1, "a", None)}
