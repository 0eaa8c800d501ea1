"""Stream queries, drained over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans._base import query, table
from leafmill.plans.review import ERRORS, MOVES, STATES
from leafmill.scratch import Tables
from leafmill.streaming import jobs, ordered


@query("SELECT conv_id AS task, md5(string_agg(text, '' ORDER BY turn)) AS digest, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY 1")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text deltas of one task each, with a done event behind them."""
    tables = Tables(spark)
    turns = table(spark, sf_dir, "conversations")
    deltas = turns.select(F.col("conv_id").alias("task"), F.col("turn").cast("long").alias("seq"), F.lit("text_delta").alias("kind"), "text", F.length("text").cast("long").alias("tokens"))
    done = turns.groupBy(F.col("conv_id").alias("task")).agg((F.max("turn") + 1).cast("long").alias("seq")).select("task", "seq", F.lit("done").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("tokens"))
    path = tables.path("events")
    deltas.unionByName(done).write.parquet(path)
    found = jobs.drained(jobs.assembled_answers(jobs.opened(spark, path)), tables, "answers")
    return found.select("task", F.md5("text").alias("digest"), "tokens")


@query(f"WITH RECURSIVE {MOVES} SELECT user_id AS task, event_id AS seq, status, before, legal FROM fold WHERE rn > 0")
def stream_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.opened(spark, f"{sf_dir}/events.parquet")
    events = rows.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.expr(STATES).alias("status"), F.expr(ERRORS).alias("error"))
    return jobs.drained(jobs.task_states(events), Tables(spark), "states")


@query("""
SELECT user_id AS project, strftime(ts::DATE, '%Y-%m-%d') AS day, sum(floor(value)::BIGINT)::BIGINT AS tokens, sum(floor(value)) > 200 AS over FROM events
GROUP BY user_id, ts::DATE HAVING (ts::DATE + 1)::TIMESTAMP <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR
""")
def stream_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.opened(spark, f"{sf_dir}/events.parquet")
    events = rows.select(F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("tokens"))
    return jobs.drained(jobs.daily_usage(events, "6 hours", 200), Tables(spark), "usage")


@query("SELECT DISTINCT source, sha256(text) AS sha256 FROM documents")
def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.opened(spark, f"{sf_dir}/documents.parquet").select("source", F.sha2("text", 256).alias("sha256"))
    return jobs.intake(rows, Tables(spark), ["source", "sha256"])


@query(f"""
WITH RECURSIVE {MOVES.replace("ORDER BY event_id", "ORDER BY ts, event_id")}
SELECT f.user_id AS task, f.event_id AS seq, f.status, before, legal FROM fold f JOIN events USING (event_id) WHERE rn > 0 AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 16 * 86400000::BIGINT
""")
def stream_ordered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task events in batches of a week, of which every third comes a batch late, judged in order of time as far as the
    watermark has come."""
    tables, rows = Tables(spark), table(spark, sf_dir, "events")
    week = F.floor(F.dayofmonth("ts") / 8) + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    events = rows.select(F.col("user_id").alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(STATES).alias("status"), F.expr(ERRORS).alias("error"), week.alias("week"))
    path = tables.path("late")
    ordered.late_batches(events, "week", path)
    stream = spark.readStream.schema(events.drop("week").schema).option("maxFilesPerTrigger", 1).parquet(path)
    return jobs.drained(ordered.task_states(stream, "16 days"), tables, "ordered")
