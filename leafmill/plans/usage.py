"""Usage queries: events are calls of tasks, a user is a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import usage
from leafmill.plans._base import query, table

TOK = "(value * 100)::BIGINT"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("tokens", F.floor(F.col("value") * 100).cast("long"))


@query("SELECT user_id, sum(floor(value * 100)::BIGINT)::BIGINT AS input_tokens, sum(event_id % 50)::BIGINT AS output_tokens, sum(event_id % 7)::BIGINT AS cached_tokens FROM events GROUP BY 1")
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).select("user_id", F.col("tokens").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"), (F.col("event_id") % 7).alias("cached_tokens"))
    return usage.per_run(rows, "user_id")


@query("SELECT user_id, strftime(ts::DATE, '%Y-%m-%d') AS day, sum(floor(value * 100)::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(calls(spark, sf_dir), "user_id", "ts", F.col("tokens")).withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, round(sum((floor(value * 100) * 3 + (event_id % 50) * 15) / 1e6), 6) AS cost, count(*) AS tasks FROM events GROUP BY 1")
def task_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(usage.cost(F.col("tokens"), F.col("event_id") % 50, 3.0, 15.0)), 6).alias("cost"), F.count("*").alias("tasks"))


@query("""
WITH RECURSIVE r AS (SELECT user_id, event_id, ts::DATE AS day, ceil(length(props) / 4.0)::BIGINT + floor(value * 100)::BIGINT AS est, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS rn FROM events),
fold AS (
  SELECT DISTINCT user_id, day, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0::BIGINT AS used, 0::BIGINT AS now, false AS allowed FROM r
  UNION ALL SELECT r.user_id, r.day, r.rn, r.event_id, f.now, CASE WHEN est <= 6000 AND f.now + est <= 12000 THEN f.now + est ELSE f.now END, est <= 6000 AND f.now + est <= 12000
  FROM fold f JOIN r ON r.user_id = f.user_id AND r.day = f.day AND r.rn = f.rn + 1
) SELECT user_id, event_id, used, allowed FROM fold WHERE rn > 0
""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).withColumn("est", usage.request_estimate(F.col("props"), F.col("tokens")))
    return usage.budget_gate(rows, "user_id", "ts", "event_id", "est", 6000, 12000).select("user_id", "event_id", "used", "allowed")


@query("SELECT l_orderkey, (3 * (max(l_orderkey % 900) + sum(least(5000, greatest(1200, l_quantity * 60 * 2)))))::DOUBLE AS budget FROM lineitem GROUP BY 1")
def generation_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("words", F.col("l_quantity") * 60)
    return usage.generation_budget(rows, "l_orderkey", "words", F.col("l_orderkey") % 900).withColumn("budget", F.col("budget").cast("double"))


@query("SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0 AND c_custkey % 10 > 0 AND c_custkey > 0 AND coalesce(c_acctbal, 0) >= 0) AS valid FROM customer GROUP BY 1")
def budget_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = usage.valid_budget(F.col("c_acctbal"), (F.col("c_custkey") % 10).cast("double"), F.col("c_custkey").cast("double"), cost=F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(ok).alias("valid"))


@query("""
SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 9 > 0 AND c_acctbal >= 0) AS active, count(*) FILTER (WHERE c_custkey % 9 > 0 AND c_acctbal < 0) AS archived, count(*) FILTER (WHERE c_custkey % 9 = 0) AS trashed,
       sum(coalesce(f, 0))::BIGINT AS completed, sum(coalesce(n, 0))::BIGINT AS planned, CASE WHEN sum(coalesce(n, 0)) > 0 THEN floor(100 * sum(coalesce(f, 0)) / sum(coalesce(n, 0)) + 0.5) ELSE 0 END::BIGINT AS progress
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1
""")
def project_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    rows = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").na.fill(0, ["n", "f"])
    rows = rows.withColumn("trashed_at", F.when(F.col("c_custkey") % 9 == 0, F.lit(1))).withColumn("status", F.when(F.col("c_acctbal") < 0, "archived").otherwise("active"))
    return usage.dashboard(rows, "c_nationkey", "f", "n")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
