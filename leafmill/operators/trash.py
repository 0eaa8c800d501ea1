"""Trash with a cascade over foreign keys, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.scratch import Tables

STONE = "name string, id string, since timestamp, root string"


class Graph:
    """Tables that refer to each other: ``ids``: table to its id column; ``foreign``: table to {column: parent table}.

    A tombstone (name, id, since, root) hides a row; ``root`` names the row that was put into the trash, as table:id, and
    each row below it gets one of its own. A row that two roots hide comes back when both do.
    """

    def __init__(self, ids: dict[str, str], foreign: dict[str, dict[str, str]]):
        self.ids, self.foreign = ids, foreign

    def children(self, parents: set[str]) -> list[tuple[str, str, str]]:
        """(child, column, parent) of the references to these tables."""
        return [(child, column, parent) for child, refs in self.foreign.items() for column, parent in refs.items() if parent in parents]

    def trashed(self, data: dict[str, DataFrame], name: str, keys: DataFrame, tables: Tables) -> DataFrame:
        """Tombstones of some rows of a table (id, since) and of all that refers to them, however far: a walk over the
        references, a level at a time, until no row is new. Each level is written and joined, so no group is gathered."""
        own = data[name].select(F.col(self.ids[name]).cast("string").alias("id"))
        start = keys.select(F.col("id").cast("string").alias("id"), "since").join(own, "id", "left_semi").dropDuplicates(["id"])
        level = tables.save(start.select(F.lit(name).alias("name"), "id", "since", F.concat(F.lit(f"{name}:"), "id").alias("root")), "trash")
        found, at = [level], {name}
        while refs := self.children(at):
            below = []
            for child, column, parent in refs:
                rows = data[child].select(F.col(self.ids[child]).cast("string").alias("id"), F.col(column).cast("string").alias("_up"))
                above = level.where(F.col("name") == parent).select(F.col("id").alias("_up"), "since", "root")
                below.append(rows.join(above, "_up").select(F.lit(child).alias("name"), "id", "since", "root"))
            new = reduce(DataFrame.unionByName, below).distinct()
            seen = reduce(DataFrame.unionByName, found).select("name", "id", "root")
            level = tables.save(new.join(seen, ["name", "id", "root"], "left_anti"), "trash")
            if level.isEmpty():
                break
            found.append(level)
            at = {child for child, _, _ in refs}
        return reduce(DataFrame.unionByName, found)

    def restored(self, stones: DataFrame, name: str, keys: DataFrame) -> DataFrame:
        """The tombstones without those that came with these roots; rows below that were trashed by themselves stay."""
        roots = keys.select(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("root")).distinct()
        return stones.join(roots, "root", "left_anti")

    def live(self, data: dict[str, DataFrame], stones: DataFrame) -> dict[str, DataFrame]:
        """The tables without what tombstones hide."""
        out = {}
        for name, df in data.items():
            gone = stones.where(F.col("name") == name).select(F.col("id").alias("_gone")).distinct()
            out[name] = df.join(gone, F.col(self.ids[name]).cast("string") == F.col("_gone"), "left_anti")
        return out

    def purged(self, data: dict[str, DataFrame], stones: DataFrame, before: str) -> tuple[dict[str, DataFrame], DataFrame]:
        """(tables, tombstones) after rows that have been in the trash since before a time are gone for good."""
        old = stones.where(F.col("since") < F.lit(before).cast("timestamp"))
        return self.live(data, old), stones.join(old.select("name", "id").distinct(), ["name", "id"], "left_anti")
