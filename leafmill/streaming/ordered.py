"""Streams whose events come late: they wait in state until the watermark has passed them, then count in order of time.

What comes later than the watermark allows is dropped, as the watermark says; everything else gives the rows of a batch
over the whole log, however it was cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.operators.review import moved

_TIME = GroupStateTimeout.EventTimeTimeout


def _waiting(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """(milliseconds, columns) of the rows that have come, as Python's values: a task has few at a time, and pandas'
    operations on them would cost more than all else."""
    out = []
    for pdf in frames:
        at = (pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64") // 1000).tolist()
        out += zip(at, *([None if v is None or v != v else v for v in pdf[c].tolist()] for c in columns), strict=True)
    return out


def task_states(events: DataFrame, delay: str) -> DataFrame:
    """(task, seq, status, before, legal) of each event (task, ts, seq, status, error), in order of ts, then seq: the batch
    job's rule, for events up to ``delay`` late. An event comes out once the watermark has passed its time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, *held = state.get if state.exists else (None, [], [], [], [])
        waiting = list(zip(*held, strict=True))
        if not state.hasTimedOut:
            waiting += [(at, int(seq), status, error) for at, seq, status, error in _waiting(frames, ["seq", "status", "error"])]
        waiting.sort(key=lambda e: e[:2])
        passed = state.getCurrentWatermarkMs()
        due, rest, out = [e for e in waiting if e[0] < passed], [e for e in waiting if e[0] >= passed], []
        for _, seq, status, error in due:
            legal = moved(now, status, error)
            out.append((key[0], seq, status, now, legal))
            now = status if legal else now
        state.update((now, *([e[k] for e in rest] for k in range(4))))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0], passed + 1))
        if out:
            yield pd.DataFrame(dict(zip(["task", "seq", "status", "before", "legal"], map(list, zip(*out, strict=True)), strict=True)))

    marked = events.select("task", "ts", "seq", "status", "error").withWatermark("ts", delay)
    return marked.groupBy("task").applyInPandasWithState(step, "task long, seq long, status string, before string, legal boolean", "status string, at array<long>, seqs array<long>, states array<string>, errors array<string>", "append", _TIME)


def answers(events: DataFrame, delay: str, idle: str) -> DataFrame:
    """(task, text, tokens, outcome) of streams of (task, ts, seq, kind, text, tokens): text deltas in order of seq and
    the usage that was reported, up to the task's first done event in order of time, once the watermark has passed that
    event. A blank result is "empty"; a task without a done event for ``idle`` of event time comes out as "abandoned"
    with what there is. A task comes out once; what comes for it behind that is left out, until as much time has passed
    again and its memory goes."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over, *held = state.get if state.exists else (False, [], [], [], [], [])
        waiting = list(zip(*held, strict=True))
        if state.hasTimedOut and over:
            state.remove()
            return
        if not state.hasTimedOut and not over:
            waiting += [(at, int(seq), kind, text or "", int(n or 0)) for at, seq, kind, text, n in _waiting(frames, ["seq", "kind", "text", "tokens"])]
        passed = state.getCurrentWatermarkMs()
        ends = [e[:2] for e in waiting if e[2] == "done"]
        stop, last = min(ends, default=None), max((e[0] for e in waiting), default=passed)
        if not over and (stop and stop[0] < passed or not stop and last + wait < passed):
            mine = sorted((e for e in waiting if stop is None or e[:2] <= stop), key=lambda e: e[1])
            text = "".join(e[3] for e in mine if e[2] == "text_delta")
            outcome = "abandoned" if stop is None else "ok" if text.strip() else "empty"
            over, waiting = True, []
            yield pd.DataFrame({"task": [key[0]], "text": [text], "tokens": [sum(e[4] for e in mine)], "outcome": [outcome]})
        state.update((over, *([e[k] for e in waiting] for k in range(5))))
        state.setTimeoutTimestamp(max(passed + 1, passed + wait if over else stop[0] if stop else last + wait))

    marked = events.select("task", "ts", "seq", "kind", "text", "tokens").withWatermark("ts", delay)
    return marked.groupBy("task").applyInPandasWithState(step, "task long, text string, tokens long, outcome string", "over boolean, at array<long>, seqs array<long>, kinds array<string>, texts array<string>, tokens array<long>", "append", _TIME)


def late_batches(rows: DataFrame, batch: str, path: str) -> list[str]:
    """Write rows as one folder of files for each value of ``batch``, oldest files first: a source for streams in which
    rows come in the batches named. Many tasks read and choose the rows, one writes each file."""
    out = []
    for value in sorted(r[0] for r in rows.select(batch).distinct().collect()):  # a row a batch
        rows.where(F.col(batch) == value).drop(batch).repartition(1).write.mode("append").parquet(path)
        out.append(str(value))
    return out
