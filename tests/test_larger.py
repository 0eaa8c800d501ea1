"""Queries against their SQL on tables of rows that the smallest tables do not have."""

import random

import duckdb
import pytest
from test_search import best, new

from leafmill.operators import search, structure
from leafmill.plans import registry


def both(spark, folder, name, **tables):
    """The rows of a query and those of its SQL over tables of (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.sql(f"create view {table} as select * from '{path}/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    wanted = con.sql(registry.ORACLES[name])
    order = [got.columns.index(c) for c in wanted.columns]
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return plain(tuple(r[i] for i in order) for r in got.collect()), plain(wanted.fetchall())


def test_upper_case_of_letters_without_one_for_one(spark, tmp_path):
    texts = ["ßa", "ßeta", "ŉ", "ᾳb", "ﬁn", "ǆ", "ä" * 5, "", None]
    rows = [(n * 3 + 1, t, "de", "src0", 1) for n, t in enumerate(texts)]
    got, wanted = both(spark, tmp_path, "batch_generation", documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == wanted and len(got) == len(texts)


def test_gate_of_a_source_with_more_chapters_than_a_snapshot_may_have(spark, tmp_path):
    rows = [(n, "x" if n % 2 else None, "de", "src3" if n < 40 else "src0", 1) for n in range(structure.MAX_CHAPTERS + 100)]
    got, wanted = both(spark, tmp_path, "snapshot_gate", documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == wanted and got


def test_limits_of_a_snapshot(spark):
    chapters = spark.createDataFrame([("a", 1, 0, "t", "xx"), ("a", 2, 1, "t", "x"), ("b", 3, 0, "t", "x")], "doc string, chapter long, ordinal int, title string, content string")
    segments = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "chapter long, ordinal int")
    too_large = lambda **how: {r["doc"] for r in structure.snapshot_violations(chapters, segments, "doc", "chapter", **how).where("rule = 'too_large'").collect()}
    assert too_large() == set() == too_large(limits=None)
    assert {"a"} == too_large(limits=(1, 9, 9)) == too_large(limits=(9, 1, 9)) == too_large(limits=(9, 9, 2))


@pytest.mark.parametrize("rare", [0, 3, 1000])
def test_rare_tokens_and_blocks_find_the_same(spark, monkeypatch, rare):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "RARE", rare)
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{int(rng.random() ** 2 * 30)}" for _ in range(n))
    docs = {n: (text(rng.randint(0, 12)), rng.choice("ab")) for n in range(120)}
    asked = [(n, text(rng.randint(1, 3)), rng.choice(["a", None])) for n in range(40)] + [(50, "w1 unknown", None)]
    index = new(spark)
    index.put(spark.createDataFrame([(k, *v) for k, v in docs.items()], "id int, text string, owner string"), "text", "owner")
    index.put(spark.createDataFrame([(3, "w1 w2 w2 w29", "a"), (200, "w1 w0", "b")], "id int, text string, owner string"), "text", "owner")
    docs |= {3: ("w1 w2 w2 w29", "a"), 200: ("w1 w0", "b")}
    got = index.search(spark.createDataFrame(asked, "q int, text string, whose string"), "q", 4, owner="whose").collect()
    assert {(r["q"], r["id"], r["rank"]) for r in got} == best(docs, asked, 4) and len(got) > 20


def test_postings_are_not_dealt_out_one_by_one(spark):
    """Writing blocks deals out documents, once."""
    index = new(spark)
    made = spark.createDataFrame([(1, "a", 2, [("x", 1), ("y", 1)])], f"id int, owner string, size int, terms {search._TERMS}")
    plans = []
    monkey = index.store.write
    index.store.write = lambda name, df, note=None: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), monkey(name, df, note))[1]
    index._written(made, 1)
    plan = dict(plans)["blocks"]
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")
