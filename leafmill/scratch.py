"""Shared working folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir`` or the folder that the context has for checkpoints. Where neither is
    set, a local session gets a temporary one; on a cluster, whose machines share no such folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/leafmill-{uuid.uuid4().hex}"


#: Rows for each partition of ``dealt``.
ROWS = 500_000


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by keys to as many partitions as the session has, or to one for every ROWS rows if these are more, so
    that what a task sorts does not grow with the table. Rows are counted first; ``like``: a scan of about as many rows,
    for a ``df`` that is not cheap to count."""
    n = -(-(df if like is None else like).count() // ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


class Tables:
    """Tables of one run, written once and read again, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, folder(spark), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
