"""Versions of tables in a shared folder, each complete or not there at all.

A commit writes its tables into folders of their own, claims the next number and writes the manifest last; a version
counts once its manifest is complete. Folders never change, so a version can carry tables of earlier ones, readers keep
what they have read, and what a crashed commit leaves is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Entry:
    """A table of a version: its folder, its schema, and what the committer says of it."""

    name: str
    folder: str
    schema: str
    note: str = "{}"

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(self.folder)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """The numbers of complete versions, ascending."""
        fs, where = self._fs(f"{self.path}/manifest")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{n}/_SUCCESS")))

    def latest(self) -> int:
        """The last complete version; 0 if there is none."""
        return max(self.versions(), default=0)

    def entries(self, version: int | None = None) -> list[Entry]:
        version = self.latest() if version is None else version
        if version == 0:
            return []
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        rows = self.spark.read.schema("place int, name string, folder string, schema string, note string").json(f"{self.path}/manifest/{version:08d}").orderBy("place").collect()  # a row a table
        return [Entry(r["name"], r["folder"], r["schema"], r["note"]) for r in rows]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the latest if none is named."""
        for e in self.entries(version):
            if e.name == name:
                return e.read(self.spark)
        raise ValueError(f"no table {name}")

    def write(self, name: str, df: DataFrame, note: dict | None = None) -> Entry:
        """Write a table into a folder of its own; no version holds it yet."""
        folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return Entry(name, folder, df.schema.json(), json.dumps(note or {}))

    def commit(self, entries: list[Entry], after: int | None = None) -> int:
        """A version of these tables, the one behind ``after`` (the latest if none is named). If another commit has come
        behind ``after``, this one is refused and leaves no version."""
        after = self.latest() if after is None else after
        if self.latest() != after:
            raise Conflict(f"version {self.latest()} came first")
        number = after + 1
        fs, claim = self._fs(f"{self.path}/claims/{number:08d}")
        while not fs.createNewFile(claim):  # of two commits one gets the number; a claim without a manifest was given up
            if self.latest() >= number:
                raise Conflict(f"version {number} came first")
            number += 1
            _, claim = self._fs(f"{self.path}/claims/{number:08d}")
        rows = [(n, e.name, e.folder, e.schema, e.note) for n, e in enumerate(entries)]
        made = self.spark.createDataFrame(rows, "place int, name string, folder string, schema string, note string")
        made.coalesce(1).write.json(f"{self.path}/manifest/{number:08d}")
        return number
