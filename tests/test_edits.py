"""Batches of edits whose texts are read and cut once."""

from leafmill.operators import structure
from leafmill.scratch import Tables

EDITS = "chapter_id string, op string, offset int, title string"


def test_sizes_of_merged_blank_parts(spark):
    texts = ["　", "a\r\nb", " \n", "c", "", " ", "d\re ", "\t"]
    rows = spark.createDataFrame([("b", f"c{i}", i, f"t{i}", x) for i, x in enumerate(texts)], "book string, chapter_id string, ordinal int, title string, content string")
    merges = [(f"c{i}", "merge", None, None) for i in (0, 1, 2, 4, 6)]
    for edits in (merges, [*merges, ("c1", "split", 2, None), ("c5", "move", 1, None)], []):
        got = structure.edit_batch(rows, spark.createDataFrame(edits, EDITS)).orderBy("ordinal").collect()
        assert all(r["end"] - r["start"] == len(r["content"]) for r in got)
        assert [r["start"] for r in got[1:]] == [r["end"] + 2 for r in got[:-1]]
        if edits == merges:
            assert [r["content"] for r in got] == ["a\nb\n\n\n\nc", "", "d\ne"]


def test_chapters_are_read_once(spark):
    tables = Tables(spark)
    path = tables.path("chapters")
    spark.createDataFrame([("b", f"c{i}", i, f"t{i}", f"text {i}") for i in range(9)], "book string, chapter_id string, ordinal int, title string, content string").write.parquet(path)
    done = structure.edit_batch(spark.read.parquet(path), spark.createDataFrame([("c3", "split", 2, None), ("c5", "merge", None, None)], EDITS))
    assert done.count() == 9 and not [f for f in done.inputFiles() if path.removeprefix("file://") in f]
