"""Contexts and prompts of small projects in rows, and of larger ones by blocks, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import context

SPANS = "project int, kind string, id int, tokens int, priority int, lo int, hi int"


def greedy(spans, project, target, budget):
    seen = [x for x in spans if project is not None and target is not None and x[0] == project and (x[5] is None or x[5] <= target) and (x[6] is None or target <= x[6])]
    used, kept = 0, []
    for _, kind, key, tokens, *_ in sorted(seen, key=lambda x: (-x[4], str(x[2]), x[1], x[3])):
        if tokens <= budget - used:
            used += tokens
            kept.append((kind, str(key), tokens))
    return used, tuple(kept)


def made(spark, rng, n=160):
    point = lambda a: rng.choice([None, rng.randint(a, 30)])
    spans = [(rng.choice([None, 0, 0, 0, 1, 2]), rng.choice(["fact", "summary"]), k, rng.randint(1, 9), rng.randint(0, 5), point(-3), point(0)) for k in range(n)]
    targets = [(rng.choice([None, 0, 0, 0, 1, 7]), rng.choice([None, rng.randint(-2, 33)])) for _ in range(70)]
    targets += targets[:5]
    return spans, targets, spark.createDataFrame(spans, SPANS), spark.createDataFrame(targets, "project int, target int")


@pytest.mark.parametrize("small", [0, 30, 10**6])
def test_contexts_of_any_size_of_project(spark, monkeypatch, small):
    monkeypatch.setattr(context, "SMALL", small)
    spans, targets, df, dt = made(spark, random.Random(small))
    got = [(r["project"], r["target"], r["used"], tuple(tuple(s) for s in r["sources"])) for r in context.fitted(df, dt, 25).collect()]
    assert sorted(got, key=repr) == sorted(((p, t, *greedy(spans, p, t, 25)) for p, t in set(targets)), key=repr)
    assert any(used for _, _, used, _ in got)


def dealt_by(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]


def test_nothing_of_small_projects_is_dealt_by_target(spark):
    _, _, df, dt = made(spark, random.Random(9))
    keys = dealt_by(context.fitted(df, dt, 25))
    assert keys and all(k == ["project"] for k in keys)


def test_each_project_goes_one_way(spark, monkeypatch):
    """The one project with more candidates goes by blocks, the others in rows."""
    monkeypatch.setattr(context, "SMALL", 40)
    rng, seen = random.Random(4), []
    spans, _, df, dt = made(spark, rng)
    blocks = context._fitted_by_blocks
    monkeypatch.setattr(context, "_fitted_by_blocks", lambda s, t, b: (seen.extend({r["project"] for r in s.select("project").collect()}), blocks(s, t, b))[1])
    assert context.fitted(df, dt, 25).count() == dt.distinct().count()
    assert seen == [0] and sum(x[0] == 0 for x in spans) > 40


@pytest.mark.parametrize(("small", "chars"), [(0, 10**6), (6, 10**6), (10**6, 10**6), (10**6, 20)])
def test_prompts_of_any_size_of_project(spark, monkeypatch, small, chars):
    monkeypatch.setattr(context, "SMALL", small)
    monkeypatch.setattr(context, "SMALL_TEXTS", chars)
    rng = random.Random(small)
    texts = {(p, kind, k): rng.choice([None, "", "x\ny", "林" * (k or 1)]) for p in (None, 0, 1, 2) for kind in ("fact", "passage", None) for k in (None, *range(rng.choice([2, 9])))}
    rows = [(*k, t) for k, t in texts.items()] * 2
    ids = [(kind, str(k), 1) for kind in ("fact", "passage", "none") for k in range(9)]
    made = [(rng.choice([None, 0, 1, 2, 5]), n, f"c{n}", rng.sample(ids, rng.choice([0, 1, 5]))) for n in range(40)]
    df = spark.createDataFrame(made, "project int, target int, context_id string, sources array<struct<kind:string,id:string,tokens:int>>")
    got = {(r["target"], r["context_id"]): r["prompt"] for r in context.prompts(df, spark.createDataFrame(rows, "project int, kind string, id int, text string")).collect()}
    text = lambda p, kind, k: (texts.get((p, kind, int(k))) or "") if p is not None else ""
    assert got == {(n, c): "\n\n".join(f"[{kind}:{k}]\n{text(p, kind, k)}" for kind, k, _ in sources) for p, n, c, sources in made}
    assert len(got) == 40


def test_prompts_of_small_projects_are_dealt_by_project(spark):
    df = spark.createDataFrame([(1, 2, "c", [("fact", "3", 1)])], "project int, target int, context_id string, sources array<struct<kind:string,id:string,tokens:int>>")
    prompts = context.prompts(df, spark.createDataFrame([(1, "fact", 3, "t")], "project int, kind string, id int, text string"))
    keys = dealt_by(prompts)
    assert all(k == ["project"] for k in keys) and prompts.first()["prompt"] == "[fact:3]\nt"


def test_stored_contexts_go_before_the_others_are_dealt(spark):
    ids = lambda *x: spark.createDataFrame([(i, i * 2) for i in x], "context_id int, n int")
    fresh = context.new_snapshots(ids(1, 2, 2, 3), ids(3, 4))
    assert sorted((r["context_id"], r["n"]) for r in fresh.collect()) == [(1, 2), (2, 4)]
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftAnti")
