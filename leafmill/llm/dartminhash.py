"""Near-duplicate documents by DartMinHash (Christiani, 2020) and banded joining.

A text's five-word shingles are weighted elements. Every element owns a Poisson process of hashed darts over the plane
of weight and rank, each dart marked with one of ``bands * rows`` coordinates. A text catches the darts below its
elements' weights; the earliest by rank on each coordinate is its signature, and two texts agree on a coordinate with
the probability of their weighted Jaccard similarity. Only about k log k darts are thrown per text, however long it is:
the planes are cut into regions, and a region's hash says how many darts it holds.

Joining: texts that share a band are compared exactly with the band's smallest member first. Where what bands hold
together still falls into several components, all pairs across components whose signatures agree enough are compared
too, in blocks, so no link between different texts is lost, while near copies that already link cost one comparison each.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._graph import components
from leafmill.llm._words import U64, Words, column_bytes, distinct_by_text, mix, released, shingles, slices
from leafmill.scratch import Tables

BANDS, ROWS, WIDTH, THRESHOLD = 20, 5, 5, 0.8
#: Texts of a block at most, two of which a task holds.
BLOCK = 4096


def _poisson_cdf(mean: float) -> np.ndarray:
    n = int(mean + 12 * np.sqrt(mean) + 20)
    logs = np.arange(n) * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def _darts(elements, weights, owner, theta, k):
    """(owner, coordinate, rank, dart) of every dart below the elements' weights and the owners' rank limits."""
    found = []
    heaviest, furthest = float(weights.max(initial=0)), float(theta.max(initial=0))
    nu, w_low, w_high = 0, 0.0, 1.0
    while w_low < heaviest:
        rho, r_low, r_high = 0, 0.0, 1 / 16
        while r_low < furthest:
            here = np.flatnonzero((weights > w_low) & (theta[owner] > r_low))
            region = mix(elements[here] ^ mix(np.full(1, 1000 * nu + rho + 1, U64)))
            counts = np.searchsorted(_poisson_cdf((w_high - w_low) * (r_high - r_low)), _unit(region), "right")
            which = np.repeat(here, counts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = mix(np.repeat(region, counts) + mix(nth + 1))
            rank = r_low + (r_high - r_low) * _unit(mix(dart + U64(1)))
            weight = w_low + (w_high - w_low) * _unit(mix(dart + U64(2)))
            hit = (weight < weights[which]) & (rank < theta[owner[which]])
            found.append((owner[which[hit]], (dart[hit] >> U64(32)) % U64(k), rank[hit], dart[hit]))
            rho, r_low, r_high = rho + 1, r_high, 4 * r_high
        nu, w_low, w_high = nu + 1, w_high, 2 * w_high
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (int, U64, float, U64)]


def signatures(elements: np.ndarray, first: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """One row of k dart ids per text; all zero for a text without elements. An element listed twice counts once unless
    ``weights`` says more of it."""
    n = len(first) - 1
    out = np.zeros((n, k), U64)
    weights = np.ones(len(elements)) if weights is None else weights
    sizes = np.diff(first)
    owner_all = np.repeat(np.arange(n), sizes)
    mass = np.bincount(owner_all, weights, n)
    todo = np.flatnonzero(mass > 0)
    budget = k * (np.log(k) + 2)
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        mine = place[owner_all] >= 0
        owner, coord, rank, dart = _darts(elements[mine], weights[mine], place[owner_all[mine]], budget / mass[todo], k)
        cell = owner * k + coord.astype(np.int64)
        order = np.lexsort((dart, rank, cell))
        cell, dart = cell[order], dart[order]
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        got = np.zeros(len(todo) * k, U64)
        got[cell[new]] = dart[new]
        full = np.bincount(cell[new] // k, minlength=len(todo)) == k
        out[todo[full]] = got.reshape(-1, k)[full]
        todo, budget = todo[~full], 2 * budget
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=U64), (len(sig), 1))
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        keys = mix(keys * U64(31) + parts[:, :, r])
    return keys.view(np.int64)


def _sign(width: int, bands: int, rows: int, weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column_bytes(batch.column(1))
            for i, j in slices(offs):
                words = Words(buf, offs[i : j + 1])
                elements, first = shingles(words.hash(), words.first, width)
                weights = None
                if weighting == "count":
                    text = np.repeat(np.arange(j - i), np.diff(first))
                    order = np.lexsort((elements, text))
                    elements = elements[order]
                    change = np.flatnonzero(np.r_[True, (elements[1:] != elements[:-1]) | (np.diff(text) != 0)][: len(elements)])
                    weights = np.diff(np.append(change, len(elements))).astype(float)
                    elements, first = elements[change], np.searchsorted(text[change], np.arange(j - i + 1))
                else:  # a shingle that a text repeats throws its darts once
                    elements, first = distinct_by_text(elements, first)
                sig = signatures(elements, first, bands * rows, weights)
                some = np.diff(first) > 0
                keys = band_keys(sig, bands, rows)
                small = (sig & U64(0xFFFFFFFF)).astype(np.uint32)
                digest = [hashlib.md5(buf[offs[x] : offs[x + 1]]).digest() for x in range(i, j)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(digest, pa.binary()),
                        pa.array([small[x].tobytes() if some[x] else None for x in range(j - i)], pa.binary()),
                        pa.array([keys[x] if some[x] else None for x in range(j - i)], pa.list_(pa.int64())),
                    ],
                    ["id", "h", "sig", "bands"],
                )

    return run


def _sets(col: pa.Array, width: int) -> list[np.ndarray]:
    buf, offs = column_bytes(col)
    out = []
    for i, j in slices(offs):
        words = Words(buf, offs[i : j + 1])
        v, first = distinct_by_text(*shingles(words.hash(), words.first, width))
        out += [v[first[x] : first[x + 1]] for x in range(j - i)]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum()) if len(a) else 0
    return both / (len(a) + len(b) - both)


def _compare(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        size = 0
        for batch in batches:
            b_ids = batch.column(1).to_pylist()
            fresh = [x for x in {b: n for n, b in enumerate(b_ids) if b not in kept}.values()]
            for x, s in zip(fresh, _sets(batch.column(3).take(pa.array(fresh, pa.int64())), width), strict=True):
                kept[b_ids[x]] = s
                size += len(s)
            score = np.array([jaccard(s, kept[b]) for s, b in zip(_sets(batch.column(2), width), b_ids, strict=True)])
            hit = pa.array(np.flatnonzero(score >= threshold - 1e-12))
            yield pa.record_batch([batch.column(0).take(hit), batch.column(1).take(hit), pa.array(score).take(hit)], ["a", "b", "jaccard"])
            while size > 4_000_000 and kept:
                size -= len(kept.popitem(last=False)[1])

    return run


def _across(width: int, threshold: float):
    """Links between components inside one pair of blocks: whoever agrees on enough of the signature is compared exactly,
    unless links found here already join the two. A link for each join comes out, so at most one a row."""

    def run(table: pa.Table) -> pa.Table:
        ids, comps, left, right = (table.column(c).to_pylist() for c in ("rep", "comp", "is_left", "is_right"))
        sig = np.array([np.frombuffer(x, np.uint32) for x in table.column("sig").to_pylist()])
        sets = _sets(table.column("text").combine_chunks(), width)
        root = {c: c for c in comps}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        rights = np.flatnonzero(right)
        for x in np.flatnonzero(left):
            agree = (sig[rights] == sig[x]).mean(1)
            for y in rights[agree >= threshold - 0.16]:
                if top(comps[x]) != top(comps[y]) and jaccard(sets[x], sets[y]) >= threshold - 1e-12:
                    root[top(comps[x])] = top(comps[y])
                    a.append(ids[x])
                    b.append(ids[y])
        kind = table.schema.field("rep").type
        return pa.table([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return run


def _links_across(members: DataFrame, texts: DataFrame, tables: Tables, width: int, threshold: float) -> DataFrame:
    """Links (a, b) between components of one group. ``members``: (gid, rep, comp, sig).

    A group's largest component need not be compared with itself. The rest is dealt into blocks, and every block meets
    every other block of the rest and of the largest component in a task of its own. Blocks grow with the root of the
    group, so that a row is copied about as often, up to the rows that a task can hold; beyond that copies grow with the
    group.
    """
    sizes = members.groupBy("gid", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("gid").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "comp")).alias("most"))
    sizes = sizes.where("parts > 1").withColumn("block", F.least(F.lit(BLOCK), F.greatest(F.lit(96), F.ceil(2 * F.sqrt("n")))))
    sizes = sizes.selectExpr("gid", "most.comp as main", "cast(ceil((n - most.n) / block) as int) as p", "cast(ceil(most.n / block) as int) as q")
    sizes = tables.save(sizes, "groups")
    placed = members.join(sizes, "gid").withColumn("at", F.when(F.col("comp") == F.col("main"), -1 - F.pmod(F.xxhash64("rep"), F.col("q"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("p"))).cast("int"))
    # block i of the rest is on the left of (i, j) for j >= i and for the blocks -1 .. -q of the largest component, and on the right of (j, i) for j < i
    own = F.expr("""if(at < 0, transform(sequence(0, p - 1), i -> struct(i as i, at as j)),
        concat(transform(sequence(0, p - 1), k -> struct(least(k, at) as i, greatest(k, at) as j)), transform(sequence(1, q), k -> struct(at as i, -k as j))))""")
    dealt = placed.withColumn("cell", F.explode(own)).selectExpr("gid", "cell.i as i", "cell.j as j", "rep", "comp", "sig", "at = cell.i as is_left", "at = cell.j as is_right")
    dealt = tables.save(dealt, "dealt").join(texts.withColumnRenamed("id", "rep"), "rep")
    return tables.save(dealt.groupBy("gid", "i", "j").applyInArrow(_across(width, threshold), "a long, b long"), "across")


def verified(pairs: DataFrame, texts: DataFrame, tables: Tables, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``threshold`` or more, computed on whole texts."""
    ta, tb = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return tables.save(both.mapInArrow(released(_compare(width, threshold)), "a long, b long, jaccard double"), "links")


@dataclass
class Classes:
    """``signed``: (id, h, bands) of every row; ``placed``: (h, id, component) of every distinct text with shingles, id
    being the smallest that has it."""

    signed: DataFrame
    placed: DataFrame


def _classes(docs: DataFrame, tables: Tables, width: int, threshold: float, bands: int, rows: int, weighting: str, join_ids: bool) -> Classes:
    """``docs``: (id, text). ``join_ids``: whether the texts of one id are held together."""
    kind = dict(docs.dtypes)["id"]
    signed = tables.save(docs.mapInArrow(released(_sign(width, bands, rows, weighting)), f"id {kind}, h binary, sig binary, bands array<bigint>"), "signed")
    some = signed.where("bands is not null and id is not null")
    # a distinct text is a node; its number is any that no other has and is fixed by writing it
    found = some.groupBy("h").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = tables.save(found.withColumn("rep", F.monotonically_increasing_id()), "reps")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    leaders = tables.save(banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader"), "leaders")
    shared = tables.save(banded.join(leaders, "key"), "shared")
    star = tables.save(shared.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "star")
    needed = star.select(F.col("a").alias("rep")).union(star.select("b")).distinct().join(reps.select("rep", "id", "h"), "rep")
    addressed = docs.where("id is not null").withColumn("h", F.unhex(F.md5("text")))
    texts = tables.save(addressed.join(needed.hint("merge"), ["id", "h"]).select(F.col("rep").alias("id"), "text").dropDuplicates(["id"]), "texts")
    links = verified(star, texts, tables, width, threshold)
    joined = links.select("a", "b")
    if join_ids:
        joined = joined.union(_same_ids(some, reps, tables))
    joined = tables.save(joined, "joined")
    found = components(joined, tables)
    groups = components(star, tables)  # all that share bands, whether they link or not
    members = groups.join(found.withColumnRenamed("component", "comp"), "node", "left")
    members = tables.save(members.select(F.col("component").alias("gid"), F.col("node").alias("rep"), F.coalesce("comp", "node").alias("comp")), "members")
    more = _links_across(members.join(reps.select("rep", "sig"), "rep"), texts, tables, width, threshold)
    if not more.isEmpty():
        found = components(joined.union(more), tables)
    placed = tables.save(reps.select("rep", "h", "id").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h", "id", F.coalesce("component", "rep").alias("component")), "placed")
    return Classes(signed, placed)


def _same_ids(some: DataFrame, reps: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) between the texts of an id that has several."""
    ends = some.groupBy("id").agg(F.min("h").alias("one"), F.max("h").alias("last")).where("one < last").select("id", "one")
    several = some.select("id", "h").join(ends, "id").where("h <> one").select("h", "one").distinct()
    node = reps.select("rep", "h")
    return tables.save(several.join(node.withColumnRenamed("rep", "a"), "h").join(node.select(F.col("rep").alias("b"), F.col("h").alias("one")), "one").select("a", "b"), "same_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighting: str = "set", tables: Tables | None = None) -> DataFrame:
    """(id, class_id, kept) per document: the smallest id of the group that links of ``threshold`` or more reach.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case; shingles are ``width`` words, or all
    words of a shorter text. Equal texts always share a class. Null, empty and blank texts have no shingles and equal
    nothing: each is its own class. Repeated ids give one row, and all texts of an id are in its class; rows with a null
    id give one row with a null class, kept. An empty table gives none; other columns are not read.
    ``weighting``: "set" counts a shingle once, "count" signs by how often it occurs; the exact check is on sets.
    """
    tables = tables or Tables(docs.sparkSession)
    found = _classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tables, width, threshold, bands, rows, weighting, True)
    least = found.placed.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = tables.save(found.placed.join(least, "component").select("h", "class_id"), "classes")
    each = found.signed.select("id", "h").join(classes, "h", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    out = each.groupBy("id").agg(F.min("class_id").alias("class_id"))
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighting: str = "set", tables: Tables | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near copies keeps one, all their columns as they are.

    Texts decide, not ids: of a group the text with the smallest id stays (of several texts of that id the one with the
    smallest MD5), so an id with two texts that are no near copies keeps both. Rows with the same id and text are one;
    which of their other columns stay is not defined. Texts without shingles equal nothing, but rows that repeat one with
    its id go too. Rows with a null id belong to no group and all stay.
    """
    tables = tables or Tables(docs.sparkSession)
    named = docs.where(F.col(id_col).isNotNull())
    found = _classes(named.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tables, width, threshold, bands, rows, weighting, False)
    first = found.placed.groupBy("component").agg(F.min(F.struct("id", "h")).alias("x")).select("x.id", "x.h")
    bare = found.signed.where("bands is null").select("id", "h").distinct()
    kept = tables.save(first.union(bare).select(F.col("id").alias("_lm_id"), F.col("h").alias("_lm_h")), "kept")
    marked = named.withColumn("_lm_text", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    stay = marked.join(kept, (F.col(id_col) == F.col("_lm_id")) & (F.col("_lm_text") == F.col("_lm_h")), "left_semi")
    # only ids that stand in several rows are looked at again
    often = tables.save(named.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_lm_id")), "repeated")
    again = F.col(id_col) == F.col("_lm_id")
    once = stay.join(often, again, "left_anti")
    one = stay.join(often, again, "left_semi").withColumn("_lm_null", F.col(text_col).isNull()).dropDuplicates([id_col, "_lm_text", "_lm_null"])
    return once.unionByName(one.drop("_lm_null")).drop("_lm_text").unionByName(docs.where(F.col(id_col).isNull()))
