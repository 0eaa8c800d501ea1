"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.scratch import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) for every end of the edges (a, b): the smallest node that links reach.

    Each round hooks every root to its smallest neighbour below it, follows the hooks to their ends and joins the edges'
    ends to their roots; edges inside one root go. At least half of the roots that still have edges hook in a round, so
    the rounds are logarithmic. Every table is written before it is joined, so that a join on a node with very many
    edges reads two exchanges and adaptive execution can split it.
    """
    pair = F.col("a") != F.col("b")
    ordered = edges.where(pair).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    live = tables.save(ordered.distinct(), "edges")
    roots = None
    while not live.isEmpty():
        hooks = tables.save(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        while True:  # follow the hooks, doubling the length of each jump
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = tables.save(hooks.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jumps")
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = roots.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            roots = tables.save(moved.unionByName(hooks), "roots")
        hi = hooks.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        lo = hooks.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        ends = tables.save(live.join(hi, "hi", "left").select(F.coalesce("hi_root", "hi").alias("x"), "lo"), "ends")
        ends = ends.join(lo, "lo", "left").select("x", F.coalesce("lo_root", "lo").alias("y")).where("x <> y")
        live = tables.save(ends.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    if roots is None:
        return live.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    found = roots.select("node", F.col("root").alias("component"))
    heads = found.select(F.col("component").alias("node"), "component").distinct()
    return tables.save(found.unionByName(heads), "components")
