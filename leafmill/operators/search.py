"""Full-text search over a written index: block maxima for the best hits, deltas with tombstones for upkeep.

An index is a list of segments, each written once. A segment has its documents with their terms, its postings in blocks
by token, what it adds to each token's number of documents, and the documents of earlier segments that it takes away.
Blocks gather documents of about one length, the same documents for every token, and say the largest count and the least
length that they hold; from these follows the best score that a block can give. A query with a rare token looks through
the documents that hold it; another reads the blocks with the best bounds first, then only those that can still reach its
last place.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.scratch import Tables
from leafmill.snapshots import Entry, Store

K1, B = 1.2, 0.75
#: Documents of a block, about; blocks that a query reads before it knows what its last place needs; segments of about
#: one size that are merged into one.
BLOCK, FIRST, FANOUT = 256, 4, 4
#: A token is rare if no more documents hold it than a query reads at first anyway.
RARE = FIRST * BLOCK
_TERMS = "array<struct<token:string,tf:int>>"


def _folds() -> tuple[str, str]:
    """Letters with diacritics and those without, then the combining marks, which go."""
    marked = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    plain = [unicodedata.normalize("NFD", c)[0] for c in marked]
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


_MARKED, _PLAIN = _folds()


def tokens(text: Column, tokenizer: str = "words") -> Column:
    """Lower-case tokens, runs of letters and digits. "words" takes them as they are; "unicode61" without diacritics;
    "bigram" also cuts runs of Han characters into pairs (a single one stays)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if tokenizer in ("unicode61", "bigram"):
        low = F.translate(low, _MARKED, _PLAIN)
    if tokenizer != "bigram":
        return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda run: F.when((F.length(run) > 1) & run.rlike(r"^\p{IsHan}"), pairs(run)).otherwise(F.array(run))))


def postings(segments: DataFrame, key: str, text: str, tokenizer: str = "words") -> DataFrame:
    """(token, key, tf, size): one row a token and segment."""
    cut = segments.select(key, tokens(F.col(text), tokenizer).alias("ts"))
    rows = cut.select(key, F.size("ts").alias("size"), F.explode("ts").alias("token"))
    return rows.groupBy("token", key, "size").agg(F.count("*").alias("tf"))


def _terms(rows: DataFrame, key: str) -> DataFrame:
    """(key, owner, size, terms) of rows (key, owner, ts), each row's tokens counted where it is."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                each = batch.column(2).to_pylist()
                counted = [[{"token": t, "tf": n} for t, n in sorted(Counter(ts).items())] for ts in each]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, each), pa.int32()), pa.array(counted, kind)], [key, "owner", "size", "terms"])

    return rows.select(key, "owner", "ts").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, owner string, size int, terms {_TERMS}")


class Index:
    """A kept index in a folder that driver and executors share; every change is a version of it.

    Documents have a ``key`` of one type, unique among the live ones, a text and, if named, an ``owner`` that queries may
    ask for. Null texts are empty; null keys are left out; of rows with one key in one change the greatest text counts.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, tokenizer: str = "words"):
        self.spark, self.key, self.tokenizer, self.store = spark, key, tokenizer, Store(spark, path)

    def _parts(self, name: str) -> DataFrame | None:
        """The tables of that name of all segments, with the segment's number."""
        found = [e.read(self.spark).withColumn("seg", F.lit(json.loads(e.note)["seg"])) for e in self.store.entries() if e.name == name]
        return reduce(DataFrame.unionByName, found) if found else None

    def documents(self) -> DataFrame | None:
        """(seg, key, owner, size, block, terms) of the live documents."""
        every, gone = self._parts("docs"), self._parts("gone")
        return every if every is None or gone is None else every.join(gone.drop("seg").withColumnRenamed("of", "seg"), ["seg", self.key], "left_anti")

    def live_postings(self) -> DataFrame:
        """(token, key, tf, size) of the live documents, as a rebuilt index has them."""
        return self.documents().select(F.explode("terms").alias("t"), self.key, "size").select("t.token", self.key, "t.tf", "size")

    def put(self, docs: DataFrame, text: str, owner: str | None = None) -> int:
        """Add documents; those whose key is there already take its place."""
        name = F.lit(None).cast("string") if owner is None else F.col(owner).cast("string")
        rows = docs.where(F.col(self.key).isNotNull()).select(self.key, name.alias("owner"), F.coalesce(text, F.lit("")).alias("_text"))
        rows = rows.groupBy(self.key).agg(F.max(F.struct("_text", "owner")).alias("x")).select(self.key, "x.owner", tokens(F.col("x._text"), self.tokenizer).alias("ts"))
        made = _terms(rows, self.key)
        return self._change(made, made.select(self.key))

    def drop(self, keys: DataFrame) -> int:
        """Take documents away; keys that are not there are passed over."""
        return self._change(None, keys.select(self.key).where(F.col(self.key).isNotNull()).distinct())

    def _change(self, made: DataFrame | None, keys: DataFrame) -> int:
        before, entries, old = self.store.latest(), self.store.entries(), self.documents()
        seg = 1 + max((json.loads(e.note)["seg"] for e in entries), default=0)
        new, deltas = [], []
        if made is not None:
            new += self._written(made, seg)
            made = new[0].read(self.spark)
            deltas.append(made.select(F.explode("terms.token").alias("token"), F.lit(1).alias("df")))
        if old is not None:
            taken = Tables(self.spark).save(old.join((keys if made is None else made).select(self.key), self.key, "left_semi"), "taken")
            new.append(self.store.write("gone", taken.select(F.col("seg").alias("of"), self.key), {"seg": seg, **_totals(taken, -1)}))
            deltas.append(taken.select(F.explode("terms.token").alias("token"), F.lit(-1).alias("df")))
        if not deltas:
            return before
        changed = reduce(DataFrame.unionByName, deltas).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        return self.store.commit([*entries, *new, self.store.write("stats", changed, {"seg": seg})], before)

    def _written(self, made: DataFrame, seg: int) -> list[Entry]:
        """A segment's documents and blocks. A block holds about BLOCK documents of about one length."""
        bucket = F.floor(2 * F.log2(F.col("size") + 1.0)).cast("long")
        kept = Tables(self.spark).save(made.withColumn("bucket", bucket), "made")
        rooms = kept.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("room"))  # some dozens of rows
        placed = kept.join(F.broadcast(rooms), "bucket").withColumn("block", F.col("bucket") * F.lit(1 << 40) + F.pmod(F.xxhash64(self.key), "room")).drop("bucket", "room")
        entry = self.store.write("docs", placed.sortWithinPartitions(self.key), {"seg": seg, **_totals(kept, 1)})
        # a block's documents come together before their terms are taken apart, so no posting is dealt out by itself
        each = entry.read(self.spark).repartition("block").select("block", self.key, "owner", "size", F.explode("terms").alias("t")).select("t.token", "block", F.struct(self.key, "owner", "size", "t.tf").alias("e"))
        held = each.groupBy("token", "block").agg(F.max("e.tf").alias("most"), F.min("e.size").alias("least"), F.collect_list("e").alias("held"))  # a block's documents at most
        return [entry, self.store.write("blocks", held.sortWithinPartitions("token", "block"), {"seg": seg})]

    def compact(self) -> int:
        """Merge the newest segments once FANOUT of them are small beside the one before; what they took away goes for
        good. Without that many the version stays."""
        entries, before, live = self.store.entries(), self.store.latest(), self.documents()
        seg_of = lambda e: json.loads(e.note)["seg"]
        size: dict[int, int] = {}
        for e in entries:
            size[seg_of(e)] = size.get(seg_of(e), 0) + abs(json.loads(e.note).get("docs", 0))
        group: list[int] = []
        for seg in sorted(size, reverse=True):
            if group and size[seg] > FANOUT * max(1, sum(size[s] for s in group)):
                break
            group.append(seg)
        if len(group) < FANOUT:
            return before
        rest, merged = [e for e in entries if seg_of(e) not in group], [e for e in entries if seg_of(e) in group]
        seg = max(size) + 1
        docs, blocks = self._written(live.where(F.col("seg").isin(group)).select(self.key, "owner", "size", "terms"), seg)
        notes = [json.loads(e.note) for e in merged]
        total = {"seg": seg, **{k: sum(n.get(k, 0) for n in notes) for k in ("docs", "size")}}
        new = [Entry(docs.name, docs.folder, docs.schema, json.dumps(total)), blocks]
        gone = self._parts("gone")
        if gone is not None and rest:  # what the group took from older segments stays taken
            new.append(self.store.write("gone", gone.where(F.col("seg").isin(group) & ~F.col("of").isin(group)).drop("seg"), {"seg": seg}))
        stats = self._parts("stats").where(F.col("seg").isin(group)).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        return self.store.commit([*rest, *new, self.store.write("stats", stats, {"seg": seg})], before)

    def search(self, queries: DataFrame, query: str, limit: int = 20, text: str = "text", owner: str | None = None) -> DataFrame:
        """(query, key, score, rank): the documents that hold all of a query's distinct tokens, best first by BM25, ties to
        the smaller key. Statistics are the whole index's; ``owner``: a column of the queries, null for any owner, looked
        at after matching. ``limit`` is held within 1 to 100; a query without tokens finds nothing."""
        limit, tables = max(1, min(100, limit)), Tables(self.spark)
        notes = [json.loads(e.note) for e in self.store.entries()]
        docs, total = sum(n.get("docs", 0) for n in notes), sum(n.get("size", 0) for n in notes)
        asked = queries.select(F.col(query).alias("q"), (F.lit(None).cast("string") if owner is None else F.col(owner).cast("string")).alias("whose"), F.explode(F.array_distinct(tokens(F.col(text), self.tokenizer))).alias("token"))
        kind, of = queries.schema[query].dataType.simpleString(), self._parts("docs")
        if of is None or docs <= 0:
            id_kind = "string" if of is None else of.schema[self.key].dataType.simpleString()
            return self.spark.createDataFrame([], f"{query} {kind}, {self.key} {id_kind}, score double, rank int")
        df = self._parts("stats").join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df"))
        known = asked.join(df.where("df > 0"), "token", "left")
        need = known.groupBy("q").agg(F.count("*").alias("need"), F.count("df").alias("have")).where("need = have").select("q", "need")
        known = tables.save(known.join(need, "q").withColumn("idf", F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)), "known")
        gain = lambda idf, tf, size: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (total / docs)))
        blocks, live = self._parts("blocks"), self._parts("gone")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), self.key))).where(F.col("rank") <= limit)
        rarest = known.groupBy("q", "whose").agg(F.min(F.struct("df", "token")).alias("r"), F.collect_list(F.struct("token", "idf")).alias("want"))
        rarest = tables.save(rarest.select("q", "whose", "r.df", "r.token", "want"), "rarest")

        # the documents of a query's rare token, then the query's tokens within each document's terms
        near = rarest.where(F.col("df") <= RARE).select("q", "token").join(blocks.select("token", "seg", F.col(f"held.{self.key}").alias("keys")), "token")
        near = tables.save(near.select("q", "seg", F.explode("keys").alias(self.key)), "near")
        near = self.documents().select("seg", self.key, "owner", "size", "terms").join(near, ["seg", self.key]).join(rarest.select("q", "whose", "want"), "q")
        near = near.where("(whose is null or whose = owner) and size(array_except(want.token, terms.token)) = 0").withColumn("_tf", F.map_from_entries("terms"))
        each = F.aggregate("want", F.lit(0.0), lambda total, w: total + gain(w["idf"], F.col("_tf")[w["token"]], F.col("size")))
        rare = tables.save(ranked(near.select("q", self.key, each.alias("score"))), "rare")
        common = rarest.where(F.col("df") > RARE).select("q")
        if common.isEmpty():
            return rare.select(F.col("q").alias(query), self.key, "score", "rank")

        known = tables.save(known.join(common, "q", "left_semi"), "common")
        bounds = blocks.select("token", "seg", "block", "most", "least").join(known, "token").groupBy("q", "need", "seg", "block")
        bounds = bounds.agg(F.sum(gain(F.col("idf"), F.col("most"), F.col("least"))).alias("bound"), F.count("*").alias("have")).where("have = need")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "seg", "block"))
        bounds = tables.save(bounds.withColumn("place", place).select("q", "seg", "block", "bound", "place"), "bounds")

        def hits(chosen: DataFrame) -> DataFrame:
            each = chosen.select("q", "seg", "block").join(known, "q").join(blocks.select("token", "seg", "block", "held"), ["token", "seg", "block"])
            each = each.select("q", "whose", "need", "seg", "idf", F.explode("held").alias("e"))
            found = each.groupBy("q", "whose", "need", "seg", F.col(f"e.{self.key}").alias(self.key), F.col("e.owner").alias("owner")).agg(F.sum(gain(F.col("idf"), F.col("e.tf"), F.col("e.size"))).alias("score"), F.count("*").alias("got"))
            found = found.where("got = need and (whose is null or whose = owner)")
            return found if live is None else found.join(live.drop("seg").withColumnRenamed("of", "seg"), ["seg", self.key], "left_anti")

        first = tables.save(ranked(hits(bounds.where(F.col("place") <= FIRST))).select("q", self.key, "score", "rank"), "first")
        last = first.where(F.col("rank") == limit).select("q", F.col("score").alias("floor"))
        more = bounds.where(F.col("place") > FIRST).join(last, "q", "left").where("floor is null or bound >= floor - 1e-6")
        both = first.drop("rank").unionByName(ranked(hits(more)).select("q", self.key, "score"))
        return ranked(both).unionByName(rare).select(F.col("q").alias(query), self.key, "score", "rank")


def _totals(docs: DataFrame, sign: int) -> dict[str, int]:
    row = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return {"docs": sign * row["docs"], "size": sign * row["size"]}
