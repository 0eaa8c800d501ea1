"""Mentions of changed terms, and line diffs, against plain Python."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators import governance

SPLIT = re.compile(r"""[\s，。；、：,.!?！？;:"“”'‘’（）()《》]+""")


def mentioned(items, terms, first=3):
    out = set()
    for scope, key, text in items:
        hits = sorted({(place, t) for s, t, place in terms if s == scope and t in (text or "").lower()})
        if hits:
            out.add((scope, key, tuple(t for _, t in hits[:first]), len(hits)))
    return out


def run(spark, items, terms):
    rows = governance.mentions(spark.createDataFrame(items, "s string, k int, text string"), spark.createDataFrame(terms, "s string, term string, place int"), "s", "k", "text")
    return {(r["s"], r["k"], tuple(r["terms"]), r["n_terms"]) for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mentions_equal_substring_search(spark, seed):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("ab林雨🙂é") for _ in range(rng.randint(a, b)))
    items = [(f"p{rng.randint(0, 2)}", k, rng.choice([" ", "，", ". ", "　"]).join(word(1, rng.choice([3, 12, 700])) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    items += [("p0", 100, None), ("p0", 101, ""), (None, 102, "ab ab"), ("p1", 100, "AB Ab")]
    terms = {(f"p{rng.randint(0, 3)}", word(2, rng.choice([2, 3, 4, 5, 9]))) for _ in range(60)}
    terms |= {("p0", items[k][2][:300].split()[0][:290]) for k in range(20) if items[k][2] and len(items[k][2].split()[0]) > 1}
    rows = [(s, t.lower(), n) for n, (s, t) in enumerate(sorted(terms)) if not SPLIT.search(t)]
    assert run(spark, items, rows) == mentioned(items, rows)


def test_terms_of_every_length_and_windows(spark):
    text = "".join(chr(0x4E00 + (i * 37) % 5000) for i in range(1400))
    terms = [("p", text[a : a + n], k) for k, (a, n) in enumerate([(0, 2), (254, 2), (255, 3), (253, 4), (254, 5), (250, 300), (1395, 5), (1398, 2), (0, 1400)])]
    terms += [("p", text[:5] + "x", 50), ("p", "zz", 51), ("q", text[:2], 52)]
    assert run(spark, [("p", 1, text)], terms) == mentioned([("p", 1, text)], terms)


def test_a_stretch_without_separators(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    terms = [("p", text[70_000:70_012], 1), ("p", text[99_997:], 2), ("p", "zzzz", 3), ("p", text[5:80_000], 4)]
    began = time.time()
    assert run(spark, [("p", 1, text)], terms) == mentioned([("p", 1, text)], terms)
    assert time.time() - began < 60


def test_terms_that_share_their_runs(spark):
    """Every run of four characters is in every second word, so it tells nothing; the terms still find their words."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(20)) for _ in range(20_000)})
    began = time.time()
    got = run(spark, [("p", k, w) for k, w in enumerate(words)], [("p", w, k) for k, w in enumerate(words)])
    assert got == {("p", k, (w,), 1) for k, w in enumerate(words)}
    assert time.time() - began < 60


def test_rows_of_one_key_and_equal_numbers(spark):
    items, terms = [("p", 1, "abab cd"), ("p", 1, "ab"), ("p", 2, "cd ab"), ("q", 1, "ab")], [("p", "ab", 2), ("p", "cd", 1)]
    assert run(spark, items, terms) == {("p", 1, ("cd", "ab"), 2), ("p", 2, ("cd", "ab"), 2)}
    # two runs of one number, and one run in two rows, all stay
    codes, zeros = governance._codes("abcdab"), np.zeros(3, np.uint64)
    assert governance._once(codes, np.array([0, 2, 4]), 2, np.array([0, 0, 0]), zeros).tolist() == [0, 2]
    assert governance._once(codes, np.array([0, 2, 4]), 2, np.array([0, 0, 1]), zeros).tolist() == [0, 2, 4]


def test_pieces_of_a_batch(monkeypatch):
    monkeypatch.setattr(governance, "PIECE", 10)
    texts = ["abc", "abcdefgh", "", "a" * 35, *["ab"] * 12]
    sizes = [p.num_rows for p in governance._pieces(pa.RecordBatch.from_pydict({"t": texts}), "t")]
    assert sum(sizes) == len(texts) and 4 < len(sizes) < 8 and max(sizes) >= 5
    assert sum(p.num_rows for p in governance._pieces(pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())}), "t")) == 0


def test_no_items_and_no_terms(spark):
    assert run(spark, [], [("p", "ab", 1)]) == run(spark, [("p", 1, "ab")], []) == set()


def test_key_names_match_when_asked(spark):
    frame = lambda rows: spark.createDataFrame(rows, "p string, id int, title string, text string, number int, volume_id int")
    volumes, chapters = frame([("p", 1, "v", "x", None, None)]), frame([("p", 5, "c", "y goal", 3, 1), ("p", 6, "d", "z", 4, 1)])
    none = volumes.limit(0)
    terms = spark.createDataFrame([("p", "goal", 0)], "p string, term string, place int")
    plain = {(r["kind"], r["id"], r["reason"]) for r in governance.impact_report(terms, "p", volumes, chapters, none, none).collect()}
    assert plain == {("chapter", "5", "引用了变更内容：goal"), ("volume", "1", "1 个章节引用了变更内容")}
    keyed = {(r["kind"], r["id"], r["title"]) for r in governance.impact_report(terms, "p", volumes, chapters, none, none, {"chapter": ["id", "goal"], "volume": ["goal"]}).collect()}
    assert keyed == {("chapter", "5", "第 3 章 · c"), ("chapter", "6", "第 4 章 · d"), ("volume", "1", "v")}


def walked(before, after):
    """The rule, line by line."""
    if not before or not after:
        return [("removed", x) for x in before] + [("added", x) for x in after]
    (b, *bs), (a, *as_) = before, after
    if b == a:
        return [("same", b), *walked(bs, as_)]
    if bs and bs[0] == a:
        return [("removed", b), *walked(bs, after)]
    if as_ and as_[0] == b:
        return [("added", a), *walked(before, as_)]
    return [("removed", b), ("added", a), *walked(bs, as_)]


def test_line_diffs():
    rng = random.Random(1)
    for _ in range(300):
        before, after = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert governance.line_diff(before, after) == walked(before, after)
    same = [str(i) for i in range(300)]
    assert governance.line_diff(same, same) == [("same", x) for x in same]
    assert governance.line_diff([], []) == []


def test_diffs_of_a_table(spark):
    rows = spark.createDataFrame([(1, "a\nb", "b\nc"), (2, None, "x")], "k int, before string, after string")
    got = [(r["k"], r["line_no"], r["kind"], r["line"]) for r in governance.diffs(rows, ["k"]).orderBy("k", "line_no").collect()]
    assert got == [(1, 0, "removed", "a"), (1, 1, "same", "b"), (1, 2, "added", "c"), (2, 0, "removed", ""), (2, 1, "added", "x")]
    assert governance.diffs(rows.where(F.lit(False)), ["k"]).count() == 0
