"""Late events against a batch over the whole log."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import review
from leafmill.scratch import Tables
from leafmill.streaming import jobs, ordered

START = dt.datetime(2024, 1, 1)


def streamed(spark, rows, kind, make):
    """rows: (batch, ...); each batch is a file of its own, and a last event of another task moves the watermark on."""
    tables = Tables(spark)
    path = tables.path("late")
    df = spark.createDataFrame(rows, f"batch int, {kind}")
    ordered.late_batches(df, "batch", path)
    stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)
    return jobs.drained(make(stream), tables, "out").where("task < 1000").collect()


@pytest.mark.parametrize("late", [0, 2])
def test_states_of_late_events(spark, late):
    rng = random.Random(late)
    log = []
    for task in range(6):
        for n in range(14):
            status = rng.choice(["queued", "running", "running", "paused", "succeeded", "failed", "cancelling"])
            log.append((task, START + dt.timedelta(hours=n, minutes=task), task * 100 + n, status, "e" if status == "failed" and rng.random() < 0.8 else None))
    rows = [((x[1] - START).seconds // 3600 // 4 + rng.randint(0, late), *x) for x in log] + [(99, 5000, START + dt.timedelta(days=9), 1, "queued", None)]
    got = streamed(spark, rows, "task long, ts timestamp, seq long, status string, error string", lambda s: ordered.task_states(s, "1 day"))
    batch = review.transitions(spark.createDataFrame(log, "task long, ts timestamp, seq long, status string, error string"), "task", "seq", "status", "error")
    wanted = {(r["task"], r["seq"], r["status"], r["before"], r["legal"]) for r in batch.collect()}
    assert len(got) == len(log) and {tuple(r) for r in got} == wanted


def test_what_the_watermark_has_passed_is_dropped(spark):
    rows = [(0, 1, START + dt.timedelta(days=3), 2, "running", None), (1, 2, START + dt.timedelta(days=3), 1, "queued", None), (2, 1, START, 1, "queued", None), (3, 5000, START + dt.timedelta(days=9), 1, "queued", None)]
    got = streamed(spark, rows, "task long, ts timestamp, seq long, status string, error string", lambda s: ordered.task_states(s, "1 day"))
    assert {(r["task"], r["seq"], r["legal"]) for r in got} == {(1, 2, False), (2, 1, True)}


def test_answers_of_late_deltas(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [
        (0, 1, at(0), 0, "text_delta", "a", 1), (0, 1, at(3), 3, "done", None, None), (1, 1, at(1), 1, "text_delta", "b", 2), (2, 1, at(2), 2, "usage", None, 5),
        (2, 1, at(5), 4, "text_delta", "behind", 9),
        (0, 2, at(0), 0, "text_delta", " ", 1), (1, 2, at(1), 1, "done", None, None),
        (0, 3, at(0), 0, "text_delta", "never", 1), (1, 3, at(1), 1, "text_delta", " ends", 1),
        (3, 1000, at(30), 0, "text_delta", "x", 1), (4, 1000, at(90), 0, "text_delta", "x", 1),
        (5, 1, at(89), 5, "text_delta", "much later", 1),
    ]
    got = streamed(spark, rows, "task long, ts timestamp, seq long, kind string, text string, tokens long", lambda s: ordered.answers(s, "6 hours", "1 day"))
    assert {tuple(r) for r in got} == {(1, "ab", 8, "ok"), (2, " ", 1, "empty"), (3, "never ends", 2, "abandoned")}
    assert len(got) == 3


def test_no_events(spark):
    rows = [(0, 1000, START, 1, "queued", None)]
    assert streamed(spark, rows, "task long, ts timestamp, seq long, status string, error string", lambda s: ordered.task_states(s, "1 day")) == []
    assert spark.range(1).where(F.lit(False)).count() == 0


def test_few_rows_cost_little():
    """A task's few rows are read as Python's values; by pandas' operations a frame took over a millisecond."""
    frame = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:00.001999", "2024-01-02 00:00:00.000000"]), "seq": [1, 2], "error": [None, "x"], "n": [float("nan"), 2.0]})
    day = 1_704_067_200_000
    assert ordered._waiting(iter([frame, frame.iloc[:0], frame.iloc[1:]]), ["seq", "error", "n"]) == [(day + 1, 1, None, None), (day + 86_400_000, 2, "x", 2.0), (day + 86_400_000, 2, "x", 2.0)]
    began = time.time()
    assert len(ordered._waiting((frame for _ in range(1000)), ["seq", "error", "n"])) == 2000
    assert time.time() - began < 0.5
