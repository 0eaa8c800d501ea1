"""Batch inference with a caller's function, and functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from leafmill.functions import SPACES
from leafmill.operators.review import reusable
from leafmill.operators.structure import HEADING, PREFIX, WHOLE

_HEADING = re.compile(HEADING)


def generated(requests: DataFrame, key: str, prompt: str, generate: Callable[[str], str]) -> DataFrame:
    """(key, result, outcome) of ``generate`` on each prompt: "ok", "empty" for a blank answer, or "error: ..." for one
    that raised; a failed row fails no other."""

    def one(text: str | None) -> tuple[str | None, str]:
        try:
            result = generate(text or "")
        except Exception as e:  # the caller's function may raise anything; the row says so
            return None, f"error: {e}"
        return (result, "ok") if result and result.strip() else (None, "empty")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [one(p) for p in pdf[prompt]]
            yield pd.DataFrame({key: pdf[key], "result": [r for r, _ in found], "outcome": [o for _, o in found]})

    return requests.select(key, prompt).mapInPandas(run, f"{key} {dict(requests.dtypes)[key]}, result string, outcome string")


def audited(requests: DataFrame, runs: DataFrame, generate: Callable[[str], str], violations: Column) -> tuple[DataFrame, DataFrame]:
    """(results, audit) of requests (project, kind, input_hash, prompt), one generation for each distinct input.

    An input that a succeeded run of ``runs`` (project, kind, input_hash, status, result, seq) has answered reuses its
    result; others are generated and validated: ``violations`` is an array of reasons over ``result``. results: the
    requests with result and outcome ("reused", "ok", "empty", "error: ..." or "invalid: ..."); audit: a row a generation,
    as a run: succeeded with its result, or failed with its error. Write ``audit`` before results are used twice: it is
    what the next run resumes from."""
    key = ["project", "kind", "input_hash"]
    known = reusable(requests, runs)
    fresh = known.where("reuse is null").groupBy(*key).agg(F.min("prompt").alias("prompt")).withColumn("_k", F.to_json(F.struct(*key)))
    made = fresh.drop("prompt").join(generated(fresh, "_k", "prompt", generate), "_k").drop("_k").withColumn("_why", violations)
    wrong = (F.col("outcome") == "ok") & (F.size("_why") > 0)
    outcome = F.when(wrong, F.concat(F.lit("invalid: "), F.array_join("_why", ","))).otherwise(F.col("outcome"))
    made = made.withColumn("result", F.when(~wrong, F.col("result"))).withColumn("outcome", outcome).drop("_why")
    results = known.join(made.withColumnRenamed("result", "_made"), key, "left")
    results = results.withColumn("result", F.coalesce("reuse", "_made")).withColumn("outcome", F.when(F.col("reuse").isNotNull(), "reused").otherwise(F.col("outcome"))).drop("reuse", "_made")
    audit = made.select(*key, F.when(F.col("outcome") == "ok", "succeeded").otherwise("failed").alias("status"), "result", F.when(F.col("outcome") != "ok", F.col("outcome")).alias("error"))
    return results, audit


@udtf(returnType="ordinal int, title string, content string")
class Chapters:
    """A text's chapters, as ``structure.chapters`` cuts them at HEADING."""

    def eval(self, text: str):
        out, title, body = [], PREFIX, []
        for line in re.sub(r"\r\n?", "\n", text or "").split("\n"):
            if _HEADING.match(line):
                out.append((title, body))
                title, body = line.strip(SPACES), []
            else:
                body.append(line)
        out.append((title, body))
        kept = [(t, "\n".join(b).strip(SPACES)) for t, b in out]
        if len(kept) > 1 and not kept[0][1]:
            kept = kept[1:]
        for n, (t, content) in enumerate(kept):
            yield n, t if len(out) > 1 else WHOLE, content


@udtf(returnType="ordinal int, content string")
class TextPieces:
    """A text cut at a separator, one row a piece."""

    def eval(self, text: str, separator: str):
        for n, piece in enumerate((text or "").split(separator)):
            yield n, piece


def register_functions(spark: SparkSession) -> None:
    """``text_chapters(text)`` and ``text_pieces(text, separator)`` for SQL."""
    spark.udtf.register("text_chapters", Chapters)
    spark.udtf.register("text_pieces", TextPieces)
