"""Token usage, cost and budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators._fold import folded

TASK_CAP, DAY_CAP = 120_000, 1_000_000


def per_run(calls: DataFrame, run: str) -> DataFrame:
    """Input, output and cached tokens of each run's calls."""
    return calls.groupBy(run).agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")))


def daily(tasks: DataFrame, project: str, ts: str, tokens: Column) -> DataFrame:
    """(project, day, tokens): whatever the status, by the session's time zone."""
    return tasks.groupBy(project, F.to_date(ts).alias("day")).agg(F.sum(tokens).alias("tokens"))


def cost(input_tokens: Column, output_tokens: Column, price_in: float, price_out: float) -> Column:
    """Of tokens, at prices per million."""
    return (input_tokens * price_in + output_tokens * price_out) / 1e6


def request_estimate(prompt: Column, max_output: Column) -> Column:
    return F.ceil(F.length(prompt) / 4).cast("long") + max_output


def budget_gate(requests: DataFrame, project: str, ts: str, seq: str, estimate: str, task_cap: int = TASK_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """Requests with ``used``, what the project's admitted ones of the day take before it, and ``allowed``; a refused
    request takes nothing. A cap of 0 does not limit."""

    def step(used, tokens):
        used, tokens = used or 0, max(0, math.ceil(tokens or 0))
        fits = not (task_cap > 0 and tokens > task_cap or day_cap > 0 and used + tokens > day_cap)
        return used + fits * tokens, (used, fits)

    rows = requests.withColumn("_day", F.to_date(ts))
    return folded(rows, [project, "_day"], [ts, seq], [estimate], step, [T.StructField("used", T.LongType()), T.StructField("allowed", T.BooleanType())]).drop("_day")


def generation_budget(scenes: DataFrame, chapter: str, target_words: str, context_tokens: Column) -> DataFrame:
    """(chapter, budget): three candidates of the context and each scene's room, 1,200 to 5,000 tokens."""
    room = F.least(F.lit(5000), F.greatest(F.lit(1200), F.col(target_words) * 2))
    return scenes.groupBy(chapter).agg((F.lit(3) * (F.max(context_tokens) + F.sum(room))).alias("budget"))


def valid_budget(*limits: Column, cost: Column) -> Column:
    """All limits finite and above zero, the cost not below."""
    ok = ~F.isnan(cost) & (cost >= 0) & (cost < float("inf"))
    for x in limits:
        ok = ok & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.coalesce(ok, F.lit(False))


def dashboard(projects: DataFrame, by: str, done: str, target: str) -> DataFrame:
    """Per group: active, archived and trashed projects, completed chapters and progress in percent."""
    rows = projects.groupBy(by).agg(F.count_if(F.col("trashed_at").isNull() & (F.col("status") == "active")).alias("active"), F.count_if(F.col("trashed_at").isNull() & (F.col("status") == "archived")).alias("archived"), F.count_if(F.col("trashed_at").isNotNull()).alias("trashed"), F.sum(done).alias("completed"), F.sum(target).alias("planned"))
    return rows.withColumn("progress", F.when(F.col("planned") > 0, F.floor(100 * F.col("completed") / F.col("planned") + 0.5)).otherwise(0).cast("long"))
