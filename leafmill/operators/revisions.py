"""Documents with their children in revisions: a new parse replaces the active set, earlier ones stay readable."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.scratch import Tables
from leafmill.snapshots import Store


class Revisions:
    """Tables of documents and of what belongs to them (chapters, segments, ...) in one store.

    A document is known by its ``identity`` columns: when the same one comes again it keeps its id, gets the next
    revision, and its children are replaced by the new ones. Every commit appends; what is active follows from the latest
    revision of a document, so an earlier revision can be read, and made the active one again.

    ``key``: the id that children carry; ``children``: names of their tables.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, identity: list[str], children: list[str]):
        self.spark, self.store = spark, Store(spark, path)
        self.key, self.identity, self.children = key, identity, children

    def _all(self, name: str, version: int | None = None) -> DataFrame | None:
        found = [e.read(self.spark) for e in self.store.entries(version) if e.name == name]
        return reduce(DataFrame.unionByName, found) if found else None

    def latest(self, version: int | None = None) -> DataFrame | None:
        """(key, revision): the active revision of each document."""
        every = self._all("documents", version)
        return None if every is None else every.groupBy(self.key).agg(F.max("revision").alias("revision"))

    def put(self, documents: DataFrame, children: dict[str, DataFrame]) -> int:
        """Commit a parse of some documents and all their children. Of documents with one identity the smallest id
        counts, with its own children."""
        before, entries, known = self.store.latest(), self.store.entries(), self._all("documents")
        one = documents.groupBy(*self.identity).agg(F.min(self.key).alias(self.key))
        new = documents.join(one, [*self.identity, self.key], "left_semi").dropDuplicates([self.key])
        if known is None:
            numbered = new.withColumn("_own", F.col(self.key)).withColumn("revision", F.lit(1))
        else:
            held = known.groupBy(*self.identity).agg(F.min(self.key).alias("_held"), F.max("revision").alias("_last"))
            numbered = new.join(held, self.identity, "left").withColumn("_own", F.col(self.key)).withColumn(self.key, F.coalesce("_held", self.key)).withColumn("revision", F.coalesce("_last", F.lit(0)) + 1).drop("_held", "_last")
        numbered = Tables(self.spark).save(numbered, "numbered")
        rename = numbered.select(F.col("_own").alias(self.key), F.col(self.key).alias("_kept"), "revision")
        moved = {n: children[n].join(rename, self.key).withColumn(self.key, F.col("_kept")).drop("_kept") for n in self.children}
        return self._commit(entries, before, numbered.drop("_own"), moved)

    def _commit(self, entries: list, before: int, documents: DataFrame, children: dict[str, DataFrame]) -> int:
        new = [self.store.write("documents", documents, {"after": before}), *(self.store.write(n, df, {"after": before}) for n, df in children.items())]
        return self.store.commit([*entries, *new], before)

    def active(self, name: str, version: int | None = None) -> DataFrame:
        """The active rows of "documents" or of a table of children, as of a version of the store or now."""
        return self._all(name, version).join(self.latest(version), [self.key, "revision"], "left_semi")

    def snapshot(self, name: str, back: int = 0) -> DataFrame:
        """The rows of each document ``back`` revisions before the active one; documents that have none so old are not
        there."""
        at = self.latest().select(self.key, (F.col("revision") - back).alias("revision"))
        return self._all(name).join(at, [self.key, "revision"], "left_semi")

    def restore(self, wanted: DataFrame) -> int:
        """Make an earlier revision (key, revision) of some documents the active one: it is written as their next one.
        What has no such revision is passed over; of several of one document the latest counts."""
        before, entries = self.store.latest(), self.store.entries()
        chosen = wanted.groupBy(self.key).agg(F.max("revision").alias("_from"))
        plan = chosen.join(self.latest().withColumnRenamed("revision", "_last"), self.key).select(self.key, F.col("_from").alias("revision"), (F.col("_last") + 1).alias("_next"))
        plan = Tables(self.spark).save(plan.join(self._all("documents").select(self.key, "revision"), [self.key, "revision"], "left_semi"), "plan")
        again = lambda name: self._all(name).join(plan, [self.key, "revision"]).withColumn("revision", F.col("_next")).drop("_next")
        return self._commit(entries, before, again("documents"), {n: again(n) for n in self.children})

    def history(self) -> list[tuple[int, str]]:
        """(version it came behind, table) of every commit's tables, in order."""
        return [(json.loads(e.note)["after"], e.name) for e in self.store.entries()]
