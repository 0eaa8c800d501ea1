"""Streams: model-event assembly, task states, daily usage and corpus intake."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.operators.review import moved
from leafmill.scratch import Tables


def drained(stream: DataFrame, tables: Tables, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, into a table, and read that."""
    out = tables.path(name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def assembled_answers(events: DataFrame, idle: str | None = None) -> DataFrame:
    """(task, text, tokens, outcome) of streams of (task, seq, kind, text, tokens) once ``done`` has come: deltas joined
    in order, usage summed; a blank result is "empty". Kinds are text_delta, usage and done.

    What comes after a task's done event is left out. With ``idle``, for streams that do not end by themselves, a task
    without events for so long ends: unfinished ones come out as "abandoned" with what there is, and the memory of
    finished ones goes. A stream that is drained has no use for it: with a timeout Spark keeps waiting for it."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def row(task: int, parts: list[str], seqs: list[int], tokens: int, outcome: str | None = None) -> pd.DataFrame:
        text = "".join(p for _, p in sorted(zip(seqs, parts, strict=True)))
        return pd.DataFrame({"task": [task], "text": [text], "tokens": [tokens], "outcome": [outcome or ("ok" if text.strip() else "empty")]})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, seqs, tokens, done = (list(state.get[0]), list(state.get[1]), state.get[2], state.get[3]) if state.exists else ([], [], 0, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(key[0], parts, seqs, tokens, "abandoned")
            return
        closed = done
        for pdf in frames:
            for r in () if closed else pdf.itertuples():
                if r.kind == "text_delta":
                    parts.append(r.text or "")
                    seqs.append(int(r.seq))
                tokens += 0 if pd.isna(r.tokens) else int(r.tokens)
                done = done or r.kind == "done"
        state.update(([], [], 0, True) if done else (parts, seqs, tokens, done))
        if wait:
            state.setTimeoutDuration(wait)
        if done and not closed:
            yield row(key[0], parts, seqs, tokens)

    return events.groupBy("task").applyInPandasWithState(step, "task long, text string, tokens long, outcome string", "parts array<string>, seqs array<long>, tokens long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def task_states(events: DataFrame) -> DataFrame:
    """(task, seq, status, before, legal) of each event (task, seq, status, error): the batch job's rule, with the state
    that the legal events so far have made, also across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        now, before, legal = state.get[0] if state.exists else None, [], []
        for status, error in zip(rows["status"], rows["error"], strict=True):
            before.append(now)
            legal.append(moved(now, status, None if pd.isna(error) else error))
            now = status if legal[-1] else now
        state.update((now,))
        yield pd.DataFrame({"task": key[0], "seq": rows["seq"], "status": rows["status"], "before": before, "legal": legal})

    return events.groupBy("task").applyInPandasWithState(step, "task long, seq long, status string, before string, legal boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def daily_usage(events: DataFrame, delay: str, cap: float) -> DataFrame:
    """(project, day, tokens, over) of days that the watermark has passed; rows later than ``delay`` are dropped."""
    days = events.withWatermark("ts", delay).groupBy("project", F.window("ts", "1 day")).agg(F.sum("tokens").alias("tokens"))
    return days.select("project", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tokens", (F.col("tokens") > cap).alias("over"))


def intake(stream: DataFrame, tables: Tables, keys: list[str]) -> DataFrame:
    """Rows of a stream whose key is new, appended batch by batch; a batch that runs again adds nothing."""
    out = tables.path("intake")

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        jpath = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(out)
        if jpath.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(jpath):
            stored = batch.sparkSession.read.schema(stream.schema).parquet(out)
            fresh = fresh.join(stored.select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(out)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table, which may be one file: a pattern is not taken for a folder of partitions."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
