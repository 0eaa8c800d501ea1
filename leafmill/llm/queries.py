"""The numbered queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, cells, dartminhash, decontaminate, extraction, langid, maxent, resampling, secret_ledger, shards, simple8b, spelling, toxicity
from leafmill.scratch import Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def part(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), part("id", 5) != 0)
    held_out = (part("doc_id", 5) == 0).alias("held_out")
    return toxicity.score(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents").select("doc_id"), shards.table(spark, shards.names()), "doc_id")


def op3_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    model, counts = maxent.learn(docs.where(part("doc_id", 7) != 2), tables, "doc_id", "text")
    return maxent.score(docs.select("doc_id", "text", (part("doc_id", 7) == 2).alias("held_out")), model, counts, tables)


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of one ledger, as of two days: the second finds every pair of blob and rule version there already."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    ledger = tables.path("ledger")
    secret_ledger.scanned(secret_ledger.addressed(docs), tables, ledger, secret_ledger.RULES)
    return secret_ledger.report(docs, tables, ledger)


def op6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_file_digest(table(spark, sf_dir, "documents"), Tables(spark), vocabulary("byte_bpe_50k.json"), pattern())


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, part("id", 5) != 0)
    held_out = (part("doc_id", 5) == 0).alias("held_out")
    return langid.predict(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extracted(pages, extraction.learn(pages))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_lookup_sharding, op3_latent_retrieval, op4_maxent, op5_secret_ledger, op6_cells, op7_simple8b, op8_bpe, op9_minhash, op10_language, op11_resampling, op12_extraction, op13_spelling)}
ORACLES: dict[str, str] = {"op2_lookup_sharding": shards.oracle(), "op11_resampling": resampling.oracle(), "op12_extraction": extraction.oracle(), "op13_spelling": spelling.oracle()}
