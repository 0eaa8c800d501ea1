"""Books as text files that many tasks write."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.scratch import Tables
from leafmill.sources import exports


def read(spark, path):
    files = {}
    for r in exports.read_books(spark, path, "book").collect():
        files.setdefault(r["book"], []).append((r["file"], r["text"]))
    return {b: ("".join(t for _, t in sorted(parts)), len(parts)) for b, parts in files.items()}


@pytest.mark.parametrize("markdown", [False, True])
def test_files_are_the_manuscript(spark, markdown):
    rng = random.Random(2)
    rows = [(rng.choice(["long"] * 9 + ["a", "ü"]), n, f"t{n}", rng.choice(["  x\n\ny　", "林" * 50, "z" * 2000, ""])) for n in range(400)]
    df = spark.createDataFrame(rows, "book string, n int, title string, content string")
    tables = Tables(spark)
    path = tables.path("books")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        write(spark, df, path, tables, markdown)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def write(spark, df, path, tables, markdown):
    places = exports.write_manuscripts(df, "book", "n", "title", "content", path, tables, markdown)
    got = read(spark, path)
    wanted = {r["book"]: r["manuscript"] + ("" if markdown else "\n") for r in exports.manuscripts(df, "book", "n", "title", "content", markdown).collect()}
    assert {b: t for b, (t, _) in got.items()} == wanted
    assert got["long"][1] > 1  # more than one task wrote it
    for r in places.collect():
        data = wanted[r["book"]].encode()
        part = data[r["at"] : r["at"] + r["bytes"]].decode()
        assert part.startswith(f"{'## ' if markdown else ''}第{r['n']}章 t{r['n']}\n\n"), r


def test_no_books_and_null_parts(spark):
    df = spark.createDataFrame([("b", 1, None), ("b", 2, "x"), ("c", 1, None)], "book string, n int, part string")
    tables = Tables(spark)
    exports.write_books(df, "book", "n", "part", tables.path("one"), tables)
    path = tables.path("two")
    exports.write_books(df, "book", "n", "part", path, tables, tail="!\n")
    assert read(spark, path) == {"b": ("x!\n", 1)}
    with pytest.raises(ValueError):
        exports.write_books(df, "book", "n", "part", path, tables, between=" ")
    assert exports.write_books(df.where(F.lit(False)), "book", "n", "part", tables.path("none"), tables).count() == 0


def test_a_shelf_is_dealt_once_for_all_its_editions(spark):
    rows = [(b, n, f"{b}{n} " + "z" * (n * 37 % 500)) for b in ("long", "b", None) for n in range(300 if b == "long" else 3)]
    df, tables, conf = spark.createDataFrame(rows, "book string, id int, text string").repartition(3), Tables(spark), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # a file is read by several tasks
    try:
        shelf = exports.numbered(exports.shelved(df, "book", ["id"], tables), "book", "n", tables)
        assert all(r["n"] == r["id"] for r in shelf.collect())
        for between in ("\n\n", "-\n"):
            path = tables.path("edition")
            exports.write_books(shelf, "book", "n", "text", path, tables, between=between)
            wanted = {b: between.join(t for own, _, t in rows if own == b) + "\n" for b in ("long", "b", None)}
            assert {b: t for b, (t, _) in read(spark, path).items()} == wanted
    finally:
        spark.conf.unset(conf)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
