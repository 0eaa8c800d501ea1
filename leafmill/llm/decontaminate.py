"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of PASSAGE words over FEATURES hashed words. One pass counts passages by feature; one
more gathers the product of the passages' TF-IDF Gram matrix with a random test matrix, summed over tasks in Spark, from
which a Nystroem step takes the leading singular vectors (Halko, Martinsson and Tropp, 2011; Tropp et al., 2017). The
last pass folds every window of every document into the latent space and compares it with all benchmark items by cosine,
in blocks; candidates are decided by the longest common subsequence of words, and paraphrases also by their answer, the
item's last words. Only candidates whose common words, counted with repeats, are too few for that, or that miss an answer
they need, are left out before: no subsequence is longer than the common words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._words import PUNCTUATION, Words, column_bytes, released, slices

FEATURES, RANK, EXTRA, PASSAGE, STRIDE = 8192, 48, 16, 64, 16
COSINE, SHARE, PARAPHRASE, ANSWER, LEAST_WORDS = 0.38, 0.75, 0.5, 5, 5
#: Items whose latent vectors are compared in one pass; more make more passes.
ITEMS_AT_ONCE = 20_000
_CHUNKS, _SALTS = 128, 16


def _words(batch_column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    buf, offs = column_bytes(batch_column)
    for i, j in slices(offs):
        words = Words(buf, offs[i : j + 1], between=PUNCTUATION)
        yield i, j, words, words.hash()


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7)).astype(np.int64) % FEATURES


def _entries(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, feature, count) of a slice, by passage; passages are numbered from 0."""
    n = np.diff(words.first)
    per = -(-n // PASSAGE)
    start = np.cumsum(per) - per
    place = np.arange(words.count) - np.repeat(words.first[:-1], n)
    passage = np.repeat(start, n) + place // PASSAGE
    key, count = np.unique(passage * FEATURES + _feature(hashes), return_counts=True)
    return key // FEATURES, key % FEATURES, count


def _sums(table: np.ndarray, rows: np.ndarray, begin: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The sums of ``table[rows]``, times ``weight``, over the stretches of rows that begin at ``begin``; none is empty.

    Stretches are cut into pieces of up to STRIDE rows and ordered by size: the first rows of all pieces are added at
    once, then their second rows, and so on. numpy's reduceat, which goes row by row, adds up only the pieces.
    """
    length = np.diff(begin, append=len(rows))
    pieces = -(-length // STRIDE)
    end = np.cumsum(pieces)
    start = np.repeat(begin - STRIDE * (end - pieces), pieces) + STRIDE * np.arange(end[-1])
    size = np.minimum(np.repeat(begin + length, pieces) - start, STRIDE)
    order = np.argsort(-size, kind="stable")
    start = start[order]
    total = np.zeros((len(start), table.shape[1]), table.dtype)
    for k in range(STRIDE):
        at = start[: np.count_nonzero(size > k)] + k
        part = table[rows[at]]
        if weight is not None:
            part *= weight[at, None]
        total[: len(at)] += part
    out = np.empty_like(total)
    out[order] = total
    return out if len(out) == len(begin) else np.add.reduceat(out, end - pieces, axis=0)


def _rows(vector: np.ndarray) -> pa.RecordBatch:
    """A task's sums, cut by feature so that many tasks add them up."""
    parts = np.array_split(np.ascontiguousarray(vector), _CHUNKS)
    salt = TaskContext.get().partitionId() % _SALTS
    return pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([salt] * _CHUNKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "salt", "part"])


def _summed(rows: DataFrame, dtype: str) -> bytes:
    """The sums over all tasks: first within salts, then across them. The result's size is fixed."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype).astype(np.float64) for x in table.column("part"))
        return pa.table([table.column("chunk")[:1], table.column("salt")[:1], pa.array([total.astype(dtype).tobytes()], pa.binary())], ["chunk", "salt", "part"])

    kind = "chunk int, salt int, part binary"
    once = rows.groupBy("chunk", "salt").applyInArrow(add, kind)
    total = once.groupBy("chunk").applyInArrow(add, kind).collect()  # _CHUNKS rows
    return b"".join(bytes(r["part"]) for r in sorted(total, key=lambda r: r["chunk"]))


@dataclass
class Latent:
    """``fold``: a word's feature to its weighted latent row, (FEATURES, rank) in single precision."""

    fold: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        total = self.fold[_feature(hashes)].sum(0, dtype=np.float64)
        return total / (np.linalg.norm(total) or 1.0)


def fit(docs: DataFrame, text_col: str = "text") -> Latent:
    """Document frequencies and singular vectors over every passage of every document."""
    texts = docs.select(text_col)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES + _CHUNKS, np.float64)  # passages are counted in the last places
        for batch in batches:
            for _, _, words, hashes in _words(batch.column(0)):
                passage, feature, _ = _entries(words, hashes)
                seen[:FEATURES] += np.bincount(feature, minlength=FEATURES)
                seen[FEATURES] += passage[-1] + 1 if len(passage) else 0
        yield _rows(seen)

    kind = "chunk int, salt int, part binary"
    counts = np.frombuffer(_summed(texts.mapInArrow(frequencies, kind), "<f8") or bytes(8 * (FEATURES + 1)), "<f8")
    total = max(float(counts[FEATURES:].sum()), 1.0)
    idf = (np.log((total + 1) / (counts[:FEATURES] + 1)) + 1e-3).astype(np.float32)
    width = RANK + EXTRA
    test = np.linalg.qr(np.random.default_rng(7).standard_normal((FEATURES, width)))[0]
    omega = test.astype(np.float32)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((FEATURES, width), np.float32)
        for batch in batches:
            for _, _, words, hashes in _words(batch.column(0)):
                passage, feature, count = _entries(words, hashes)
                if not len(passage):
                    continue
                weight = ((1 + np.log(count)) * idf[feature]).astype(np.float32)
                begin = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                norm = np.sqrt(np.add.reduceat(weight**2, begin))
                weight /= np.maximum(norm, 1e-12)[passage]
                y = _sums(omega, feature, begin, weight)
                order = np.argsort(feature.astype(np.uint16), kind="stable")
                f = feature[order]
                first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
                out[f[first]] += _sums(y, passage[order], first, weight[order])
        yield _rows(out)

    raw = _summed(texts.mapInArrow(gram, kind), "<f4")
    sketch = np.frombuffer(raw, "<f4").reshape(FEATURES, width).astype(np.float64) if raw else np.zeros((FEATURES, width))
    shift = 1e-6 * max(np.linalg.norm(sketch), 1e-12)
    shifted = sketch + shift * test
    core = test.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, 1e-9 * max(values.max(), 1e-12))
    u, s, _ = np.linalg.svd(shifted @ (vectors / np.sqrt(values)), full_matrices=False)
    sigma = np.sqrt(np.maximum(s**2 - shift, 1e-12))[:RANK]
    keep = sigma > 1e-3 * sigma[0]
    return Latent(np.ascontiguousarray(idf[:, None] * u[:, :RANK][:, keep] / sigma[keep], np.float32))  # rows are read one by one


@dataclass
class Item:
    """A benchmark item's words, as bit masks of their places, and its answer: the last words."""

    id: int
    words: np.ndarray

    def __post_init__(self):
        features = _feature(self.words)
        own, self.times = np.unique(features, return_counts=True)
        self.place = np.full(FEATURES + 1, len(own), np.int16)  # of a feature among the item's own; the last for others
        self.own = np.zeros(FEATURES + 1, np.uint8)  # 1 for the item's features
        self.own[own] = 1
        self.place[own] = np.arange(len(own), dtype=np.int16)
        self.last = features[-ANSWER:]
        self.masks: dict[int, int] = {}
        for k, w in enumerate(self.words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << k
        self.blocks = -(-(len(self.words) + STRIDE - 1) // STRIDE)
        self.answer = self.words[-ANSWER:].tolist()

    def common(self, window: list[int]) -> float:
        """The longest common subsequence with a window, as a share of the item's words."""
        n = len(self.words)
        full = (1 << n) - 1
        v = full
        get = self.masks.get
        for w in window:
            if m := get(w):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return 1 - v.bit_count() / n

    def possible(self, windows: np.ndarray) -> np.ndarray:
        """The rows of window features that may hold the item: equal words have equal features, so none is lost."""
        n, k = len(self.words), len(self.times)
        shared = self.own.take(windows) @ np.ones(windows.shape[1], np.float32)
        rows = np.flatnonzero(shared >= PARAPHRASE * n - 1e-9)
        if not len(rows):
            return rows
        count = np.bincount((self.place[windows[rows]] + (k + 1) * np.arange(len(rows))[:, None]).ravel(), minlength=(k + 1) * len(rows))
        common = np.minimum(count.reshape(-1, k + 1)[:, :k], self.times).sum(1)
        rows, common = rows[common >= PARAPHRASE * n - 1e-9], common[common >= PARAPHRASE * n - 1e-9]
        fits = common >= SHARE * n - 1e-9
        few = windows[rows[~fits]]
        width = few.shape[1] - len(self.last) + 1
        fits[~fits] = np.logical_and.reduce([few[:, i : i + width] == w for i, w in enumerate(self.last)]).any(1)
        return rows[fits]

    def answered(self, window: list[int]) -> bool:
        k = len(self.answer)
        return any(window[i : i + k] == self.answer for i in range(len(window) - k + 1))


def _found(column: pa.Array, latent: Latent, groups: list[tuple[int, list[Item], np.ndarray]]) -> Iterator[tuple[int, Item, float, float, bool]]:
    """(row, item, cosine, share, answered) of every item that a text holds; the best window of each."""
    for i, j, words, hashes in _words(column):
        n = np.diff(words.first)
        per = -(-n // STRIDE)
        if not per.sum():
            continue
        text = np.repeat(np.arange(j - i), per)
        end = np.cumsum(per)
        nth = np.arange(end[-1]) - np.repeat(end - per, per)
        begin = words.first[text] + nth * STRIDE
        features = _feature(hashes)
        blocks = _sums(latent.fold, features, begin)
        padded = np.concatenate([features.astype(np.uint16), np.full(STRIDE * max((g[0] for g in groups), default=1), FEATURES, np.uint16)])
        running = np.concatenate([np.zeros((1, blocks.shape[1])), np.cumsum(blocks, axis=0, dtype=np.float64)])
        best: dict[tuple[int, int], tuple] = {}
        for size, items, vectors in groups:
            stop = np.minimum(np.arange(len(text)) + size, end[text])
            windows = (running[stop] - running[:-1]).astype(np.float32)
            windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-12)
            last = np.minimum(begin + size * STRIDE, words.first[text + 1])
            for at in range(0, len(windows), 4096):  # blocks of windows against all items of a size
                near = windows[at : at + 4096] @ vectors.T
                for y in np.flatnonzero((near >= COSINE).any(0)):
                    item, rows = items[y], at + np.flatnonzero(near[:, y] >= COSINE)
                    # a window at a text's end also shows the next text's words here; the subsequence does not
                    room = max(1, (1 << 20) // (size * STRIDE))
                    parts = (rows[r : r + room] for r in range(0, len(rows), room))
                    for w in (w for part in parts for w in part[item.possible(padded[begin[part][:, None] + np.arange(size * STRIDE)])]):
                        window = hashes[begin[w] : last[w]].tolist()
                        share = item.common(window)
                        if share >= PARAPHRASE:
                            answered = item.answered(window)
                            if (share >= SHARE or answered) and share > best.get((text[w], item.id), (0, 0, -1.0))[2]:
                                best[(text[w], item.id)] = (item, float(near[w - at, y]), share, answered)
        for (t, _), (item, cosine, share, answered) in best.items():
            yield i + int(t), item, cosine, share, answered


def _grouped(items: list[Item], latent: Latent) -> list[tuple[int, list[Item], np.ndarray]]:
    out = []
    for size in sorted({x.blocks for x in items}):
        own = [x for x in items if x.blocks == size]
        out.append((size, own, np.array([latent.of(x.words) for x in own], np.float32)))
    return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Item]]:
    """The distinct items, at most about ITEMS_AT_ONCE at a time; an id with several texts has an item of each. Items with a null id or under LEAST_WORDS words are no
    evidence of a leak and are left out."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    blocks = max(1, -(-rows.count() // ITEMS_AT_ONCE))
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        items = []
        for r in got:
            for _, _, _, hashes in _words(pa.array([r["text"]], pa.large_string())):
                if len(hashes) >= LEAST_WORDS:
                    items.append(Item(r["id"], hashes))
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs_share, answered): the items that a document's text holds, with the best window of each.

    An item counts if SHARE of its words appear in order in a window a little longer than itself, or PARAPHRASE of them
    and its last ANSWER words one after another. Words are runs of letters and digits, A-Z in lower case. Null and empty
    texts hold nothing; repeated rows give rows each; an empty table on either side gives none.
    """
    latent = fit(docs, text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for items in item_blocks(benchmark):
        groups = _grouped(items, latent)

        def run(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_found(batch.column(1), latent, groups))
                rows = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1].id for f in found], pa.int64())]
                rows += [pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(rows, [id_col, "item_id", "cosine", "lcs_share", "answered"])

        part = narrow.mapInArrow(released(run), f"{id_col} {dict(docs.dtypes)[id_col]}, item_id long, cosine double, lcs_share double, answered boolean")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that hold no item, all their columns as they are; nothing is shuffled."""
    latent = fit(docs, text_col)
    place = docs.columns.index(text_col)
    for items in item_blocks(benchmark):
        groups = _grouped(items, latent)

        def run(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _found(batch.column(place), latent, groups):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs
