"""Shard placement by a permutation-filled lookup table (Maglev; Eisenbud et al., 2016), in SQL functions only.

Every shard prefers the slots of a prime-sized table in an order of its own, (offset + k * skip) mod size. The shards take
turns; at its turn a shard claims the first slot in its order that is still free, until the table is full. A row's slot
is a hash of its key modulo the size, so placing a row is one lookup in the broadcast table, the shards' shares differ by
at most one slot, and a changed shard list moves few rows.

The table's size is a parameter and no matter of the data; it is filled in one expression, a fold over probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 32, 4099


def hashed(text: Column) -> Column:
    """The first 60 bits of a string's MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot int, shard string): ``slots`` rows. Names must be distinct; ``slots`` must be a prime above their number."""
    if len(set(names)) != len(names) or not names:
        raise ValueError("shards need distinct names")
    if slots <= len(names) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above the number of shards")
    shards = F.array(*(F.struct(F.lit(n).alias("name"), F.pmod(hashed(F.lit(f"offset:{n}")), F.lit(slots)).cast("int").alias("offset"), (F.pmod(hashed(F.lit(f"skip:{n}")), F.lit(slots - 1)) + 1).cast("int").alias("skip")) for n in sorted(names)))
    n = len(names)

    def probe(state: Column, _: Column) -> Column:
        """The shard whose turn it is looks at the next slot of its order: claims it and ends its turn, or goes on."""
        turn, at, owner = state["turn"], state["at"], state["owner"]
        who = F.pmod(turn, F.lit(n))
        shard = F.element_at("shards", who + 1)
        slot = F.pmod(shard["offset"] + F.element_at(at, who + 1).cast("long") * shard["skip"], F.lit(slots)).cast("int")
        claimed = F.element_at(owner, slot + 1) < 0
        moved = F.concat(F.slice(at, 1, who), F.array(F.element_at(at, who + 1) + 1), F.slice(at, who + 2, F.lit(n)))
        taken = F.concat(F.slice(owner, 1, slot), F.array(who), F.slice(owner, slot + 2, F.lit(slots)))
        after = F.struct(F.when(claimed, turn + 1).otherwise(turn).alias("turn"), moved.alias("at"), F.when(claimed, taken).otherwise(owner).alias("owner"))
        return F.when(turn >= slots, state).otherwise(after)

    empty = F.struct(F.lit(0).alias("turn"), F.array_repeat(F.lit(0), n).alias("at"), F.array_repeat(F.lit(-1), slots).alias("owner"))
    # a shard looks at no slot twice, so so many probes are enough
    full = F.aggregate(F.sequence(F.lit(1), F.lit(n * slots)), empty, probe)["owner"]
    filled = spark.range(1).select(shards.alias("shards")).select("shards", full.alias("owner"))
    placed = filled.select("shards", F.posexplode("owner").alias("slot", "who"))
    return placed.select("slot", F.element_at("shards", F.col("who") + 1)["name"].alias("shard"))


def place(rows: DataFrame, shard_table: DataFrame, key_col: str, slots: int = SLOTS) -> DataFrame:
    """The rows with ``slot`` and ``shard`` added (columns of those names are replaced, the key among them). A null key is placed as the empty
    string; equal keys share a slot; an empty table stays empty. No row is shuffled."""
    others = [c for c in rows.columns if c not in ("slot", "shard")]
    slot = F.pmod(hashed(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    return rows.select(*others, slot.alias("slot")).join(F.broadcast(shard_table), "slot").select(*others, "slot", "shard")


def shares(placed: DataFrame) -> DataFrame:
    """(shard, n_rows, n_slots) of a placement."""
    return placed.groupBy("shard", "slot").agg(F.count("*").alias("n")).groupBy("shard").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_slots"))


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def oracle(n: int = SHARDS, slots: int = SLOTS) -> str:
    """The placement of documents in DuckDB: one step a turn."""
    h = lambda x: f"(('0x' || md5({x})[:15])::BIGINT)"
    return f"""
WITH RECURSIVE shards AS (
  SELECT i::INT AS i, name, ({h("'offset:' || name")} % {slots})::INT AS o, ({h("'skip:' || name")} % {slots - 1} + 1)::INT AS s
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({n}) t(i))
), orders AS (
  SELECT i, name, list_transform(range({slots}), lambda k: ((o + k * s) % {slots})::INT) AS slots FROM shards
), fill(turn, owner) AS (
  SELECT 0, list_transform(range({slots}), lambda k: -1)
  UNION ALL
  SELECT turn + 1, list_concat(owner[:pick], [turn % {n}], owner[pick + 2:])
  FROM (SELECT turn, owner, list_filter(slots, lambda x: owner[x + 1] < 0)[1] AS pick FROM fill JOIN orders ON i = turn % {n} WHERE turn < {slots})
), filled AS (
  SELECT slot::INT AS slot, owner[slot + 1] AS i FROM fill, range({slots}) r(slot) WHERE turn = {slots}
)
SELECT doc_id, f.slot, s.name AS shard
FROM documents d
JOIN filled f ON f.slot = {h("coalesce(d.doc_id::VARCHAR, '')")} % {slots}
JOIN shards s ON s.i = f.i
"""
