"""A corpus pipeline of five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, dartminhash, decontaminate, queries, secret_ledger, toxicity
from leafmill.scratch import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model learns from the labels of all documents given."""
    model = toxicity.learn(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id. Two texts of one doc_id are two
    documents, each with its own near copies; rows with the same doc_id and text are one; a null doc_id belongs to no
    group."""
    return dartminhash.survivors(docs, tables=Tables(spark))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that the ledger has of a text are masked where they stand, so no document goes; n_chars follows the text."""
    masked = secret_ledger.redacted(docs, Tables(spark))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of the whole text."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())
    return encoded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("tokens", tokenise),
]

#: Compression distance, MinHash, latent retrieval and BPE are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return docs
