"""Embedding near-duplicates: spherical k-means cells and blocked cosines within them.

Every distinct vector has a home cell, that of its nearest centroid, and visits each further cell whose border it is
close to: of two vectors with a cosine of ``least`` or more in different cells, at least one lies within half their
greatest chord of the plane between the two centroids, so it visits the other's home and no linked pair is missed. A
cell's rows are dealt into blocks and every two blocks meet in a task of their own, which multiplies them in double
precision, counts links and keeps a spanning set of them. Equal vectors are one row with a count until the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._graph import components
from leafmill.scratch import Tables

#: Vectors a cell should have, cells at most, and the bound of the sample that centroids are fitted on.
CELL_ROWS, CELLS, SAMPLE, ROUNDS = 1000, 2048, 20_000, 10


def unit(values: np.ndarray) -> np.ndarray | None:
    """In double precision; None for a zero vector or one with components that are not finite."""
    v = np.asarray(values, np.float64)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, dim, vec): key is null for vectors that link with nothing."""
    for batch in batches:
        keys, dims, vecs = [], [], []
        for x in batch.column(1):
            v = unit(np.array([np.nan if c is None else c for c in x.as_py()], np.float64)) if x.is_valid and x.values.null_count else unit(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None
            raw = None if v is None else v.astype("<f8").tobytes()
            vecs.append(raw)
            keys.append(None if raw is None else hashlib.md5(raw).digest())
            dims.append(None if v is None else len(v))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "key", "dim", "vec"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit rows, seeded evenly; an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return np.unique(c, axis=0)


class Cells:
    """Centroids of one dimension, and who is close to which border."""

    def __init__(self, centroids: np.ndarray, least: float):
        self.c = centroids
        gap = np.linalg.norm(centroids[:, None] - centroids[None], axis=2) if len(centroids) < 64 else np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
        np.fill_diagonal(gap, 1.0)
        self.gap, self.reach = np.maximum(gap, 1e-9), np.sqrt(2 - 2 * least) / 2 + 1e-7

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, visits): a boolean row of cells for each row, the home among them."""
        near = x @ self.c.T
        home = near.argmax(1)
        top = near[np.arange(len(x)), home]
        return home, (top[:, None] - near) / self.gap[home] <= self.reach


def _deal(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = np.array([np.frombuffer(batch.column(3)[r].as_py(), "<f8") for r in rows.tolist()])
                home, visits = cells[int(d)].places(x)
                visits[np.arange(len(x)), home] = True
                which, cell = np.nonzero(visits)
                at = pa.array(rows[which])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(cell.astype(np.int32)), pa.array(home[which] == cell)],
                    ["rep", "dim", "copies", "vec", "cell", "at_home"],
                )

    return run


def _meet(cells: dict[int, Cells], least: float):
    def run(table: pa.Table) -> pa.Table:
        dim, cell, i, j = (table.column(c)[0].as_py() for c in ("dim", "cell", "i", "j"))
        rep, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
        left, right, at_home = (np.asarray(table.column(c).to_numpy(zero_copy_only=False), bool) for c in ("is_left", "is_right", "at_home"))
        x = np.array([np.frombuffer(v.as_py(), "<f8") for v in table.column("vec")])
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        hit = x[a] @ x[b].T >= least
        if i == j:
            hit &= a[:, None] < b[None, :]
        if not at_home[b].all():  # visitors: the pair counts in the smaller home if both visit each other
            home, _ = cells[dim].places(x[b])
            _, visits = cells[dim].places(x[a])
            hit &= ~visits[:, home] | (cell < home)[None, :]
        links = np.zeros(len(x), np.int64)
        links[a] += hit @ copies[b]
        links[b] += copies[a] @ hit
        label = rep.copy()
        while True:  # the smallest id that hits reach inside this task
            la = np.minimum(label[a], np.where(hit, label[b][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
            new = label.copy()
            np.minimum.at(new, a, la)
            lb = np.where(hit, new[a][:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max)
            np.minimum.at(new, b, lb)
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(links > 0)
        return pa.table([pa.array(rep[some]), pa.array(label[some]), pa.array(links[some])], ["a", "b", "links"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, least: float = 0.95, tables: Tables | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) per row: how many other rows have a cosine of ``least`` or more with it, the
    smallest id that links reach, and whether it is that one.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, do not
    link. Rows of one id are vectors of their own, which the id alone does not link. A row without an id links like any
    other; it is kept if its links reach no id. Ids are integers. An empty table gives none; other columns are not read.
    """
    tables = tables or Tables(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    normal = tables.save(rows.mapInArrow(_normal, "id long, key binary, dim int, vec binary"), "normal")
    found = normal.where("key is not null").groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    reps = tables.save(found.withColumn("rep", F.monotonically_increasing_id()), "reps")  # written, so numbers stay
    cells = {}
    for r in reps.groupBy("dim").count().collect():  # one row for each length of vectors
        k = int(min(CELLS, max(1, r["count"] // CELL_ROWS)))
        some = reps.where(F.col("dim") == r["dim"]).select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).collect()
        cells[r["dim"]] = Cells(spherical_kmeans(np.array([np.frombuffer(x["vec"], "<f8") for x in some]), min(k, len(some))), least)
    dealt = tables.save(reps.select("rep", "dim", "copies", "vec").mapInArrow(_deal(cells), "rep long, dim int, copies long, vec binary, cell int, at_home boolean"), "dealt")
    sizes = dealt.groupBy("dim", "cell").agg(F.count_if("at_home").alias("n"), F.count_if(~F.col("at_home")).alias("m"))
    sizes = sizes.withColumn("block", F.least(F.lit(2048), F.greatest(F.lit(512), F.ceil(8 * F.sqrt("n"))))).selectExpr("dim", "cell", "cast(ceil(n / block) as int) as p", "cast(ceil(m / block) as int) as q")
    placed = dealt.join(F.broadcast(tables.save(sizes, "sizes")), ["dim", "cell"])  # a row a cell: at most CELLS a length
    at = F.when(F.col("at_home"), F.pmod(F.xxhash64("rep"), F.col("p"))).otherwise(-1 - F.pmod(F.xxhash64("rep"), F.col("q"))).cast("int")
    meets = F.expr("""if(at < 0, if(p = 0, array(), transform(sequence(0, p - 1), i -> struct(i as i, at as j))), concat(
        transform(sequence(0, p - 1), k -> struct(least(k, at) as i, greatest(k, at) as j)), if(q = 0, array(), transform(sequence(1, q), k -> struct(at as i, -k as j)))))""")
    blocks = placed.withColumn("at", at).withColumn("meet", F.explode(meets)).selectExpr("dim", "cell", "meet.i as i", "meet.j as j", "rep", "copies", "vec", "at_home", "at = meet.i as is_left", "at = meet.j as is_right")
    links = tables.save(blocks.groupBy("dim", "cell", "i", "j").applyInArrow(_meet(cells, least), "a long, b long, links long"), "links")
    joined = components(links.select("a", "b"), tables)
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    each = reps.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    each = tables.save(each.select("key", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class")), "each")
    ids = each.groupBy("class").agg(F.min("least_id").alias("component_id"))
    found = tables.save(each.join(ids, "class").select("key", "n_links", "component_id"), "found")
    out = normal.select("id", "key").join(found, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
