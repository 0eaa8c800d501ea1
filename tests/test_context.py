"""Context operators against plain Python, and one project with many chapters."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import estimated_tokens
from leafmill.operators import context


def tokens(text):
    return max(1, -(-len(text) // 4))


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_covering_makes_each_pair_once(spark, seed):
    rng = random.Random(seed)
    point = lambda: rng.choice([rng.randint(-5, 5), rng.randint(-40, 300), rng.randint(0, 2**30)])
    rows = [(rng.randint(0, 2), k, rng.choice([None, point()]), rng.choice([None, point()])) for k in range(120)]
    targets = [(rng.randint(0, 3), point()) for _ in range(60)] + [(9, 7)]
    got = context.covering(frame(spark, rows, "project int, k int, lo int, hi int"), frame(spark, targets, "project int, target int"), "lo", "hi")
    pairs = sorted((r["project"], r["k"], r["target"]) for r in got.collect())
    wanted = sorted({(p, k, t) for p, k, lo, hi in rows for q, t in targets if p == q and (lo is None or lo <= t) and (hi is None or t <= hi)})
    assert pairs == wanted


def filled(candidates, budget):
    used, kept = 0, []
    for priority, key, kind, size in sorted(candidates, key=lambda c: (-c[0], c[1], c[2])):
        if size <= budget - used:
            used += size
            kept.append((kind, key))
    return used, kept


@pytest.mark.parametrize("budget", [0, 7, 40, 1000])
def test_fitted_equals_a_greedy_walk(spark, budget):
    rng = random.Random(budget)
    text = lambda: "x" * rng.choice([1, 4, 9, 40, 150])
    facts = [(rng.randint(0, 1), k, text(), rng.randint(0, 30), rng.choice([None, rng.randint(0, 40)]), rng.randint(0, 30), rng.randint(0, 3)) for k in range(80)]
    facts += [(0, 900, "x", None, None, 1, 1), (0, 901, "x", 1, None, None, 1), (0, 902, None, 1, None, 1, None)]
    sums = [(rng.randint(0, 1), k, rng.choice(list(context.LAYERS)), text(), rng.randint(0, 30), rng.choice([None, rng.randint(0, 40)]), rng.choice([None, 5])) for k in range(40)]
    passages = [(rng.randint(0, 1), k, rng.randint(0, 30), text(), rng.random()) for k in range(60)]
    targets = [(p, t) for p in (0, 1, 2) for t in range(0, 35, 3)]
    df = frame(spark, facts, "project int, id int, text string, valid_from int, valid_through int, revealed_at int, priority int")
    ds = frame(spark, sums, "project int, id int, layer string, text string, valid_from int, valid_through int, priority int")
    dp = frame(spark, passages, "project int, id int, chapter int, text string, score double")
    dt = frame(spark, targets, "project int, target int")
    spans = context.pooled(context.fact_spans(df), context.summary_spans(ds), context.passage_spans(dp))
    got = {(r["project"], r["target"]): (r["used"], [(s["kind"], s["id"]) for s in r["sources"]]) for r in context.fitted(spans, dt, budget).collect()}
    pool = context.pooled(context.visible_facts(df, dt), context.visible_summaries(ds, dt), context.visible_passages(dp, dt))
    ids = {(r["project"], r["target"]): r["context_id"] for r in context.assembled(pool, dt, budget).collect()}
    assert ids == {(r["project"], r["target"]): r["context_id"] for r in context.fitted(spans, dt, budget).collect()}
    for p, t in targets:
        pool = [(1000 + (q or 0), str(k), "fact", tokens(x or "")) for o, k, x, a, b, r, q in facts if o == p and a is not None and r is not None and a <= t and r <= t and (b is None or b >= t)]
        pool += [(context.LAYERS[y] + (q or 0), str(k), "summary", tokens(x)) for o, k, y, x, a, b, q in sums if o == p and a <= t and (b is None or b >= t)]
        pool += [(int(s * 100 + 0.5), str(k), "passage", tokens(x)) for o, k, c, x, s in passages if o == p and c <= t]
        assert got[(p, t)] == filled(pool, budget), (p, t)


def test_a_project_of_twenty_thousand_chapters(spark):
    """Every chapter leaves a fact behind, so a target sees up to 20,000; what meets it are a few in each of its blocks."""
    n, budget = 20_000, 60
    ch = spark.range(n).select(F.lit(1).alias("project"), F.col("id").cast("int").alias("id"))
    facts = ch.select("project", "id", F.expr("repeat('x', 1 + id % 23)").alias("text"), F.col("id").alias("valid_from"), F.lit(None).cast("int").alias("valid_through"), F.col("id").alias("revealed_at"), (F.col("id") * 7919 % 1000).cast("int").alias("priority"))
    targets = ch.select("project", F.col("id").alias("target"))
    spans = context.fact_spans(facts)
    met = context._fitting(context._blocks(spans, targets, "lo", "hi").drop("lo", "hi"), ["project", "_block"], budget).join(context._looked_up(targets), ["project", "_block"])
    most = met.groupBy("target").count().agg(F.max("count")).first()[0]
    assert most <= 16 * sum(budget // s for s in range(1, 7))
    got = {r["target"]: [int(s["id"]) for s in r["sources"]] for r in context.fitted(spans, targets, budget).collect()}
    assert len(got) == n
    for t in (0, 1, 777, 9_999, n - 1):
        pool = [(1000 + k * 7919 % 1000, str(k), "fact", tokens("x" * (1 + k % 23))) for k in range(t + 1)]
        assert got[t] == [int(k) for _, k in filled(pool, budget)[1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_states_before_targets(spark, seed):
    rng = random.Random(seed)
    states = [(rng.randint(0, 1), k, rng.choice([None, *range(12)]), rng.choice("abc"), rng.choice([None, "x", "y"])) for k in range(60)]
    targets = [(p, t) for p in (0, 1, 5) for t in (0, 3, 3, 4, 11, 30)]
    got = context.state_before(frame(spark, states, "project int, id int, ordinal int, subject string, state string"), frame(spark, targets, "project int, target int"))
    wanted = {}
    for p, t in targets:
        for q, k, o, subject, state in sorted((s for s in states if s[2] is not None), key=lambda s: (s[2], s[1])):
            if p == q and o < t:
                wanted[(p, t, subject)] = state
    rows = got.collect()
    assert len(rows) == len(wanted) and {(r["project"], r["target"], r["subject"]): r["state"] for r in rows} == wanted


def test_what_comes_before_and_after(spark):
    drafts = frame(spark, [(1, k, k, t) for k, t in enumerate(["a", "", "c", "{}", "e", None])] + [(1, 9, None, "z")], "project int, id int, number int, text string")
    chapter = frame(spark, [(1, 2, 2, "own"), (1, 4, 4, "")], "project int, target int, id int, text string")
    none = frame(spark, [], "project int, target int, id int, text string")
    got = {(r["target"], r["kind"], r["id"]) for r in context.chapter_sources(chapter, none, none.drop("target"), drafts).collect()}
    assert got == {(2, "chapter", 2), (2, "prior", 0), (2, "future", 4), (4, "prior", 0), (4, "prior", 2)}
    memories = frame(spark, [(1, 1, 0, None, "accepted"), (1, 2, 1, 3, "accepted"), (1, 3, 0, None, "draft"), (1, 4, None, None, "accepted")], "project int, id int, ordinal int, visible_through int, status string")
    seen = {(r["target"], r["id"]) for r in context.visible_memories(memories, chapter.select("project", "target")).collect()}
    assert seen == {(2, 1), (4, 1), (4, 2)}


def test_nothing(spark):
    none = frame(spark, [], "project int, id int, text string, valid_from int, valid_through int, revealed_at int, priority int")
    targets = frame(spark, [(1, 3)], "project int, target int")
    made = context.fitted(context.fact_spans(none), targets, 10).first()
    assert (made["used"], made["sources"]) == (0, [])
    assert context.fitted(context.fact_spans(none), targets.limit(0), 10).count() == 0
    assert spark.range(1).select(estimated_tokens(F.lit("abcde"))).first()[0] == tokens("abcde")


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"summary": " s ", "stateChanges": [], "newFacts": [], "unresolvedThreads": []}',), ("x",), (None,)], "answer string")
    good, bad = context.chapter_memories(rows, "answer")
    for df in (good, bad):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r["memory"]["summary"] for r in good.collect()] == ["s"]
    assert [r["answer"] for r in bad.collect()] == ["x", None] and bad.columns == ["answer", "reasons"]


def test_prompts_make_their_contexts_once(spark, monkeypatch):
    from leafmill.plans import context as plans

    data, seen, made = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), plans.contexts

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(plans, "contexts", lambda *a: (df := made(*a)).mapInArrow(counted, df.schema))
    assert plans.context_prompts(spark, data).count()
    assert seen.value == spark.read.parquet(f"{data}/orders.parquet").count()
