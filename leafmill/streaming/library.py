"""A library of imported files in a folder, filled by batches or by a stream; each batch counts once."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from leafmill.scratch import Tables
from leafmill.snapshots import Store
from leafmill.sources.files import distinct_files, import_files

TABLES = ("documents", "chapters", "segments", "issues")


class Library:
    """The four tables of ``sources.files.import_files`` as versions of one store, a version a batch.

    A batch writes its tables into folders of their own and then commits them under its name: a batch that fails leaves
    nothing to be read, and one that runs again after its commit changes nothing. A file whose content is there already
    is no new document.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        found = [e.read(self.spark) for e in self.store.entries(version) if e.name == name]
        return reduce(DataFrame.unionByName, found) if found else None

    def add(self, files: DataFrame, batch: str) -> int:
        """Import files (path, content); the number of the version that holds them."""
        entries, before = self.store.entries(), self.store.latest()
        if any(json.loads(e.note)["batch"] == batch for e in entries):
            return before
        # each content is moved once, and cut once: segments and issues come from the chapters that are written
        new = Tables(self.spark).save(distinct_files(files, self.table("documents")), "files")
        made = import_files(new)
        written = {name: self.store.write(name, made[name], {"batch": batch}) for name in ("documents", "chapters")}
        made = import_files(new, written["chapters"].read(self.spark))
        written |= {name: self.store.write(name, made[name], {"batch": batch}) for name in ("segments", "issues")}
        return self.store.commit([*entries, *written.values()], before)

    def follow(self, folder: str, checkpoint: str, files_per_batch: int = 1000) -> None:
        """Import what is new in a folder since the last time, in batches; a stream that was broken off goes on where its
        last commit was."""
        stream = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
        name = checkpoint.rstrip("/").rpartition("/")[2]
        query = stream.writeStream.foreachBatch(lambda rows, n: self.add(rows.select("path", "content"), f"{name}:{n}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
