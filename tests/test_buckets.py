"""Mentions by buckets of texts, against plain Python; what is dealt is not a row for each mention."""

import random

import pytest
from test_impact import mentioned

from leafmill.operators import governance


def run(spark, items, terms, place="int"):
    rows = governance.mentions(spark.createDataFrame(items, "s string, k int, text string"), spark.createDataFrame(terms, f"s string, term string, place {place}"), "s", "k", "text")
    return sorted((r["s"], r["k"], tuple(r["terms"]), r["n_terms"]) for r in rows.collect())


def given(rng):
    word = lambda a, b: "".join(rng.choice("ab林🙂") for _ in range(rng.randint(a, b)))
    items = [(rng.choice([None, "big", "big", "p0", "p1"]), rng.choice([k, k % 7]), " ".join(word(1, rng.choice([3, 12, 60])) for _ in range(rng.randint(0, 12)))) for k in range(80)]
    terms = {(rng.choice(["big", "p0", "p1", "q"]), word(2, rng.choice([2, 3, 5, 30]))) for _ in range(80)} | {("big", items[k][2].split()[0]) for k in range(20) if len(items[k][2].split()[:1] or "") and len(items[k][2].split()[0]) > 1}
    return items, [(s, t, n) for n, (s, t) in enumerate(sorted(terms))]


@pytest.mark.parametrize(("chunk", "laid", "pairs"), [(1, 1, 1), (400, 50, 7), (10**7, 10**6, 10**6)])
def test_buckets_of_any_size(spark, monkeypatch, chunk, laid, pairs):
    for name, n in (("CHUNK", chunk), ("LAID", laid), ("PAIRS", pairs)):
        monkeypatch.setattr(governance, name, n, raising=False)
    items, terms = given(random.Random(chunk))
    whole = {}  # rows of one key count together
    for s, k, text in items:
        if s is not None:
            whole[s, k] = f"{whole.get((s, k), '')} {text}"
    assert run(spark, items, terms) == sorted(mentioned([(*k, t) for k, t in whole.items()], terms))


def test_places_of_more_than_one_field_and_terms_that_have_two(spark):
    terms = [("p", "ab", (2, 1)), ("p", "ab", (2, 1)), ("p", "ab", (1, 9)), ("p", "cd", (2, 0)), ("p", "x" * 30, (1, 10)), ("q", "ab", (0, 0))]
    got = run(spark, [("p", 1, f"zabz cd {'x' * 31}"), ("p", 2, "cd")], terms, "struct<a:int,b:int>")
    assert got == [("p", 1, ("ab", "x" * 30, "cd"), 4), ("p", 2, ("cd",), 1)]


def test_no_row_is_dealt_for_a_mention(spark, monkeypatch):
    """A thousand items hold fifty terms each; their one bucket gets each term once."""
    rows, first_of = [], governance._first_of
    monkeypatch.setattr(governance, "_first_of", lambda *a: (rows.append(a[-4].count()), first_of(*a))[1])
    words = [f"w{n:02d}x" for n in range(50)]
    got = run(spark, [("p", k, " ".join(words)) for k in range(1000)], [("p", w, n) for n, w in enumerate(words)])
    assert got == [("p", k, tuple(words[:3]), 50) for k in range(1000)] and rows == [50]


def test_terms_are_made_once_for_both_kinds_of_mentions(spark, monkeypatch):
    from leafmill.plans import governance as plans

    data, seen, made = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), plans.change_terms

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    wanted = made(spark, data).count()
    monkeypatch.setattr(plans, "change_terms", lambda *a: (df := made(*a)).mapInArrow(counted, df.schema))
    assert plans.volume_impact(spark, data).count() and seen.value == wanted


@pytest.mark.parametrize("kind", ["int", "string"])
def test_where_a_term_comes_first(spark, kind):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "，".join(rng.choice(["Ab", "ab", "aB", "cd", "e", "林林", "ÀÉ"]) for _ in range(6))])
    at = lambda: None if not (n := rng.randint(0, 9)) else n if kind == "int" else str(n)
    rows = [(rng.choice(["p", "q", None]), at(), text(), text()) for _ in range(60)]
    wanted = {}
    for s, order, before, after in rows:
        for i, piece in enumerate(dict.fromkeys(x for side in (before, after) for x in (side or "").split("，") if x)):
            if len(piece) > 1:
                mine = (order is not None, order, i) if order is not None else (False, None, i)
                wanted[s, piece.lower()] = min(wanted.get((s, piece.lower()), mine), mine, key=lambda m: (m[0], m[1] or (0 if kind == "int" else ""), m[2]))
    made = governance.changed_terms(spark.createDataFrame(rows, f"s string, o {kind}, before string, after string").repartition(2), "s", "o").collect()
    got = {(r["s"], r["term"]): (r["place"]["o"] is not None, r["place"]["o"], r["place"]["i"]) for r in made}
    assert len(made) == len(got) and got == wanted
