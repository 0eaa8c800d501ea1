"""The kept index against a plain BM25, and its upkeep against a rebuild."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from leafmill.operators import search
from leafmill.scratch import Tables
from leafmill.snapshots import Conflict, Store


def cut(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def best(docs, queries, limit):
    """docs: key to (text, owner)."""
    bags = {k: cut(t) for k, (t, _) in docs.items()}
    mean = sum(map(len, bags.values())) / max(len(bags), 1)
    df = {}
    for bag in bags.values():
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    out = set()
    for q, text, whose in queries:
        want, found = set(cut(text)), []
        for k, bag in bags.items():
            if want and want <= set(bag) and whose in (None, docs[k][1]):
                idf = lambda t: math.log((len(bags) - df[t] + 0.5) / (df[t] + 0.5) + 1)
                found.append((-round(sum(idf(t) * bag.count(t) * 2.2 / (bag.count(t) + 1.2 * (0.25 + 0.75 * len(bag) / mean)) for t in want), 9), k))
        out |= {(q, k, n) for n, (_, k) in enumerate(sorted(found)[:limit], 1)}
    return out


def new(spark, **more):
    return search.Index(spark, Tables(spark).path("index"), "id", **more)


@pytest.mark.parametrize("seed", [1])
def test_search_equals_bm25_through_changes(spark, monkeypatch, seed):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "FIRST", 1)
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(["ab", "ab", "cd", "ef", "gh", f"w{rng.randint(0, 30)}"]) for _ in range(rng.choice([0, 3, 8, 40])))
    docs, kept = {}, new(spark)
    queries = [(n, q, rng.choice([None, "p1", "p2"])) for n, q in enumerate(["ab", "ab cd", "cd ef gh ab", "w1", "ab w2", "zz", "ab zz", "", "AB,ab"])]
    asked = spark.createDataFrame(queries, "q int, text string, whose string")
    for step in range(6):
        if step % 3 == 2:
            gone = rng.sample(sorted(docs), len(docs) // 4)
            kept.drop(spark.createDataFrame([(k,) for k in [*gone, 9999, None]], "id int"))
            for k in gone:
                del docs[k]
        else:
            rows = [(k, text(), rng.choice(["p1", "p2", None])) for k in rng.sample(range(200), 70)]
            kept.put(spark.createDataFrame(rows, "id int, text string, p string"), "text", "p")
            docs |= {k: (t, p) for k, t, p in rows}
        if step == 4:
            before = len(kept.store.entries())
            kept.compact()
            assert len(kept.store.entries()) < before
        got = {(r["q"], r["id"], r["rank"]) for r in kept.search(asked, "q", 7, owner="whose").collect()}
        assert got == best(docs, queries, 7), step
    rebuilt = new(spark)
    rebuilt.put(spark.createDataFrame([(k, t) for k, (t, _) in docs.items()], "id int, text string"), "text")
    assert sorted(map(tuple, kept.live_postings().collect())) == sorted(map(tuple, rebuilt.live_postings().collect()))
    stats = lambda x: {(r["token"], r["n"]) for r in x._parts("stats").groupBy("token").agg(F.sum("df").alias("n")).where("n <> 0").collect()}
    assert stats(kept) == stats(rebuilt)


def test_blocks_that_cannot_win_are_left_out(spark, monkeypatch):
    """Of many blocks only those come to the second reading whose bound reaches the last place."""
    monkeypatch.setattr(search, "BLOCK", 4)
    rows = [(k, "word " * (1 + k % 5) + "filler " * (k % 90)) for k in range(600)]
    kept = new(spark)
    kept.put(spark.createDataFrame(rows, "id int, text string"), "text")
    got = {(r["q"], r["id"], r["rank"]) for r in kept.search(spark.createDataFrame([(1, "word")], "q int, text string"), "q", 5).collect()}
    assert got == best({k: (t, None) for k, t in rows}, [(1, "word", None)], 5)


def tokens(spark, text, kind):
    return spark.createDataFrame([(text,)], "x string").select(search.tokens(F.col("x"), kind)).first()[0]


def test_tokenizers(spark):
    assert tokens(spark, "林栀雨夜", "bigram") == ["林栀", "栀雨", "雨夜"]
    assert tokens(spark, "他 walked林栀x2 夜", "bigram") == ["他", "walked", "林栀", "x2", "夜"]
    assert tokens(spark, "林栀雨夜", "unicode61") == ["林栀雨夜"]
    assert tokens(spark, "Café CAFÉ naïve Ñandú", "unicode61") == ["cafe", "cafe", "naive", "nandu"]
    assert tokens(spark, "Café", "words") == ["café"]
    assert tokens(spark, None, "bigram") == tokens(spark, " ,", "unicode61") == []
    for c in "àéîõüçñšžőř":
        assert tokens(spark, c, "unicode61") == [unicodedata.normalize("NFD", c)[0]]


def test_pairs_and_accents_find_their_texts(spark):
    kept = new(spark, tokenizer="bigram")
    kept.put(spark.createDataFrame([(1, "林栀在雨夜里走。"), (2, "夜雨"), (3, "Le café"), (4, "栀林")], "id int, text string"), "text")
    found = lambda q: {r["id"] for r in kept.search(spark.createDataFrame([(1, q)], "q int, text string"), "q").collect()}
    assert (found("雨夜"), found("林栀"), found("cafe"), found("CAFÉ"), found("林")) == ({1}, {1}, {3}, {3}, set())


def test_awkward_changes(spark):
    kept = new(spark)
    none = spark.createDataFrame([], "id int, text string")
    query = spark.createDataFrame([(1, "rain")], "q int, text string")
    assert kept.search(query, "q").count() == 0 and kept.documents() is None
    kept.drop(none)
    kept.put(none, "text")
    kept.put(spark.createDataFrame([(1, "the rain falls"), (2, "rain"), (3, None), (None, "rain"), (2, "a rain")], "id int, text string"), "text")
    assert {(r["id"], r["rank"]) for r in kept.search(query, "q").collect()} == {(2, 1), (1, 2)}
    assert kept.search(query.limit(0), "q").count() == 0
    kept.drop(spark.createDataFrame([(1,), (2,), (3,)], "id int"))
    assert kept.search(query, "q").count() == 0 and kept.documents().count() == 0
    kept.put(spark.createDataFrame([(1, "rain " * 20_000)], "id int, text string"), "text")
    assert kept.search(query, "q").first()["id"] == 1


def test_versions_are_whole_or_not_there(spark):
    store = Store(spark, Tables(spark).path("store"))
    assert store.latest() == 0 and store.entries() == []
    one = store.write("t", spark.range(3))
    assert store.commit([one]) == 1
    two = store.write("t", spark.range(5))
    with pytest.raises(Conflict):
        store.commit([two], after=0)
    assert store.commit([two, store.write("u", spark.range(1))], after=1) == 2
    assert (store.read("t").count(), store.read("t", 1).count(), store.read("u").count()) == (5, 3, 1)
    fs, claim = store._fs(f"{store.path}/claims/00000003")  # a commit that was given up
    fs.createNewFile(claim)
    assert store.commit([one]) == 4 and store.versions() == [1, 2, 4] and store.read("t").count() == 3
    with pytest.raises(ValueError):
        store.read("u")
    with pytest.raises(ValueError):
        store.read("t", 3)
