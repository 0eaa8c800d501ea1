"""Files of books stay small however large the tables are, and their digests are those of the whole books."""

import hashlib
import random

from pyspark.sql import functions as F

from leafmill.operators.structure import joined_digests
from leafmill.scratch import Tables
from leafmill.sources import exports


def test_a_file_holds_about_a_range_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(exports, "RANGE", 20_000, raising=False)
    rng = random.Random(3)
    rows = [(rng.choice(["long"] * 5 + ["ü"]), n, rng.choice(["林", "x"]) * rng.randint(0, 900)) for n in range(400)]
    tables = Tables(spark)
    path = tables.path("books")
    shelf = exports.shelved(spark.createDataFrame(rows, "book string, n int, text string"), "book", ["n"], tables)
    exports.write_books(shelf, "book", "n", "text", path, tables, between="\n", tail="\n")
    sizes = [r["size"] for r in exports.read_books(spark, path, "book").select(F.octet_length("text").alias("size")).collect()]
    total = sum(len(t.encode()) + 1 for _, _, t in rows)
    assert sum(sizes) == total and len(sizes) > 8 and max(sizes) < 3 * 20_000
    digests = {r["book"]: r["digest"] for r in joined_digests(exports.read_books(spark, path, "book"), "book", "file", "text", between="").collect()}
    assert digests == {b: hashlib.md5("".join(t + "\n" for book, _, t in rows if book == b).encode()).hexdigest() for b in ("long", "ü")}


def test_texts_are_digested_where_they_lie(spark):
    rows = [("b", 2, None), ("b", 1, "ü"), ("b", 3, ""), ("b", 4, "林x"), (None, 1, "n"), ("c", 1, None)]
    got = {r["k"]: r["digest"] for r in joined_digests(spark.createDataFrame(rows, "k string, n int, t string").coalesce(1), "k", "n", "t", between="--", head=F.lit("h"), tail="!").collect()}
    assert got == {k: hashlib.md5(v.encode()).hexdigest() for k, v in {"b": "hü----林x!", None: "hn!", "c": "h!"}.items()}
