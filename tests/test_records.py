"""Story bible chains, characters from models and repeated names."""

from pyspark.sql import functions as F

from leafmill.operators import outline, review

LOG = "project string, kind string, candidate string, action string, value string, seq int"


def test_saves_by_hand_and_accepted_candidates_share_a_chain(spark):
    rows = [("p", "world", "c1", "accepted", "v1", 1), ("p", "world", "c2", "accepted", "v2", 2), ("p", "world", None, "saved", "v3", 3), ("p", "world", "c1", "accepted", "again", 4), ("p", "world", "c3", "rejected", "no", 5), ("p", "world", "c3", "accepted", "late", 6), ("p", "cast", None, "saved", "x", 1), ("q", "world", "c4", "accepted", "y", 9), (" ", "world", None, "saved", "z", 1), ("p", None, None, "saved", "z", 1), ("p", "world", None, "accepted", "z", 10), ("p", "world", "c9", "thought", "z", 11), ("p", "world", "c8", None, "z", 12)]
    revisions, refused = review.bible_log(spark.createDataFrame(rows, LOG))
    got = {(r["entry_id"], r["revision"], r["value"], r["source"], r["current"]) for r in revisions.collect()}
    assert got == {("bible_p_world", 1, "v1", "candidate", False), ("bible_p_world", 2, "v2", "candidate", False), ("bible_p_world", 3, "v3", "manual", True), ("bible_p_cast", 1, "x", "manual", True), ("bible_q_world", 1, "y", "candidate", True)}
    why = sorted((r["seq"], r["reason"]) for r in refused.collect())
    assert why == [(1, "no_entry"), (1, "no_entry"), (4, "decided"), (6, "decided"), (10, "unknown_action"), (11, "unknown_action"), (12, "unknown_action")]
    empty = review.bible_log(spark.createDataFrame([], LOG))
    assert empty[0].count() == empty[1].count() == 0


def test_characters(spark):
    payload = '[{"id": 4.5, "name": " 林 ", "role": "", "age": 3, "personality": ["a", "", 1, " b "], "secret": "s"}, 7, null, "x", {"id": "5", "name": {"a": 1}, "personality": "brave"}, [], {"personality": []}]'
    rows = spark.createDataFrame([(1, payload), (2, "{}"), (3, "[]"), (4, None), (5, "no json")], "k int, p string")
    got = review.normalized_characters(rows, "k", "p").collect()
    assert {r["k"] for r in got} == {1} and [r["id"] for r in got] == [4.5, 2, 3, 4, 5, 6, 7]
    first = got[0].asDict()
    assert (first["name"], first["role"], first["age"], first["personality"], first["secret"], first["goal"]) == (" 林 ", "次要角色", "青年（25–35）", ["a", " b "], "s", "待补充")
    for r in got[1:]:
        assert {c: r[c] for c in review.CHARACTER} == review.CHARACTER and r["personality"] == [review.UNFINISHED]


def test_repeated_names(spark):
    rows = spark.createDataFrame([("p", "Old Town"), ("p", " old town　"), ("p", "x"), ("p", "　"), ("p", None), ("q", "x")], "p string, name string")
    assert {(r["p"], r["name"], r["n"], r["reason"]) for r in outline.repeated(rows, ["p"], "name", fold=True).collect()} == {("p", "old town", 2, "repeated"), ("p", "", 1, "blank"), ("p", None, 1, "blank")}
    assert {(r["name"], r["reason"]) for r in outline.repeated(rows, ["p"], "name").collect()} == {("　", "blank"), (None, "blank")}
    assert outline.repeated(rows.where(F.lit(False)), ["p"], "name").count() == 0
