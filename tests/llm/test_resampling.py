"""Importance resampling against a plain Python version of its contract."""

import hashlib
import math
import re
import zlib

import duckdb
import pytest

from leafmill.llm import queries, resampling
from leafmill.ranks import ranked
from leafmill.scratch import Tables
from pyspark.sql import functions as F

from test_llm import AWKWARD, SMALL, docs, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, shortest, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, shortest=1, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    sums = []
    for texts in ([t for _, t in rows], target):
        count = [0] * buckets
        for t in texts:
            for f in runs(t, shortest, longest):
                count[zlib.crc32(f.encode()) % buckets] += 1
        sums.append(count)
    s, t = sums
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        found = runs(text, shortest, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = place
    return sorted(tuple(map(str, r[:5])) for r in out)


ROWS = [*AWKWARD, (20, "A_b-c\x00d é林7 A"), *((30 + i, prose(i % 7, 25 + i)) for i in range(60))]


@pytest.mark.parametrize("shape", [{}, {"longest": 3, "buckets": 50, "percent": 50}, {"shortest": 2, "longest": 2, "seed": 7, "least_words": 1}])
def test_against_plain_python(spark, shape):
    target = [prose(3, 40), None, "", "x y"]
    got = resampling.resampled(docs(spark, ROWS), spark.createDataFrame([(t,) for t in target], "text string"), **shape)
    names = {"least_words": "least"}
    wanted = brute(ROWS, target, **{names.get(k, k): v for k, v in shape.items()})
    assert sorted(tuple(map(str, r)) for r in got.collect()) == wanted


def test_empty_tables(spark):
    none = docs(spark, [])
    assert resampling.resampled(none, none).count() == 0
    assert resampling.resampled(docs(spark, ROWS), none).where("rank is not null").count() == sum(len(words(t)) >= 20 for _, t in ROWS) // 10


def test_texts_do_not_meet_in_a_batch(spark):
    """A run of words never reaches into the next text, whatever stands at its ends."""
    rows = [(1, "a b"), (2, "c"), (3, ""), (4, None), (5, "d e f\n")]
    got = resampling.resampled(docs(spark, rows).coalesce(1), docs(spark, rows), shortest=2, longest=2)
    assert {r["doc_id"]: r["n_features"] for r in got.collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 2}


def test_very_long_text(spark):
    rows = [(1, prose(1, 300_000)), (2, "word " * 400_000)]
    assert sorted(tuple(map(str, r)) for r in resampling.resampled(docs(spark, rows), docs(spark, [(9, "word")])).collect()) == brute(rows, ["word"])


def test_global_ranks(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("x"), F.col("id").alias("y")).repartition(5)
    got = ranked(rows, [F.col("x").desc(), F.col("y").asc()], "place", Tables(spark)).collect()
    assert [(r["x"], r["y"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(((i % 7, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert sorted(r["place"] for r in got) == list(range(1, 1001))


@pytest.mark.parametrize("name", ["op11_resampling", "op12_extraction", "op13_spelling"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    wanted = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = wanted.select(*(duckdb.ColumnExpression(c) for c in got.columns)).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
