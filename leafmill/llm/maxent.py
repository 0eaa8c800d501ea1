"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class after the four tokens before it times its own within the class. Classes: the
end and the most frequent words one each, other words of the bounded table by their last two bytes, and one class for
all rarer and unknown words. The class model is a softmax over summed weight rows, one row each for a hash of the last
two symbols (n-gram) and of two skipping pairs; a symbol is a word's class apart from its rarity. It is trained by
distributed gradient updates: in each round every task takes Adagrad steps through its share of the training documents,
and the weights are averaged over tasks by their tokens; the rounds together read every training document once.

Counts of all words stay distributed: only the bounded table is sent to tasks, and rarer words meet their counts in a
join. Rare words share their class by absolute discounting, which leaves the unknown word its mass, so the model is a
probability over the base's V + 1 outcomes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._words import U64, Words, column_bytes, mix, slices
from leafmill.scratch import Tables

#: Words of the table at most (all from some count on); symbols: 0 the end, then HEADS words, then endings; hashed rows of the three features.
TABLE, HEADS, SYMBOLS, ROWS, ROUNDS, RATE, STEP = 200_000, 31, 64, (2048, 1024, 1024), 2, 0.15, 8192
CLASSES, RARE = SYMBOLS + 1, SYMBOLS
_CHUNKS, _SALTS = 64, 8
_OFFSETS = np.cumsum((0, *ROWS))[:-1]


def _ending(words: Words) -> np.ndarray:
    """A symbol for a word's last two bytes."""
    end = words.start + words.length
    last = words.buf[np.maximum(end - 1, 0)].astype(U64) if words.count else np.zeros(0, U64)
    before = np.where(words.length > 1, words.buf[np.maximum(end - 2, 0)], 0).astype(U64) if words.count else last
    return (HEADS + 1 + (mix(last * U64(257) + before + U64(1)) % U64(SYMBOLS - HEADS - 1)).astype(np.int64)).astype(np.int64)


@dataclass
class Table:
    """The bounded table in ascending hash order: counts, and a symbol each (a head's own, or its ending's)."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether there is one)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


@dataclass
class Tokens:
    """A slice's tokens, each text's words and then its end."""

    text: np.ndarray
    hashes: np.ndarray
    place: np.ndarray
    listed: np.ndarray
    target: np.ndarray
    features: np.ndarray  # (tokens, 3) rows of the weights


def tokens(words: Words, table: Table) -> Tokens:
    n = len(words.offs) - 1
    h, ending = words.hash(), _ending(words)
    at, listed = table.find(h)
    own = np.where(listed, table.symbols[at] if len(table.symbols) else 0, ending)
    total = words.count + n
    where = np.arange(words.count) + words.by_text()
    text = np.repeat(np.arange(n), np.diff(words.first) + 1)
    symbol = np.zeros(total, np.int64)
    symbol[where] = own
    target = np.zeros(total, np.int64)
    target[where] = np.where(listed, own, RARE)
    first = words.first[:-1] + np.arange(n)
    nth = np.arange(total) - first[text]

    def back(k: int) -> np.ndarray:
        out = np.zeros(total, np.int64)
        out[k:] = symbol[: max(total - k, 0)]
        out[nth < k] = 0
        return out

    s1, s2, s3, s4 = (back(k) for k in (1, 2, 3, 4))
    rows = [(mix((a * SYMBOLS + b + seed).astype(U64)) % U64(m)).astype(np.int64) + off for a, b, seed, m, off in ((s1, s2, 0, ROWS[0], _OFFSETS[0]), (s1, s3, 10**6, ROWS[1], _OFFSETS[1]), (s2, s4, 2 * 10**6, ROWS[2], _OFFSETS[2]))]
    hashes, place, known = np.zeros(total, U64), np.zeros(total, np.int64), np.zeros(total, bool)
    hashes[where], place[where], known[where] = h, at, listed
    return Tokens(text, hashes, place, known, target, np.stack(rows, 1))


def log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = weights[features[:, 0]]
    z += weights[features[:, 1]]
    z += weights[features[:, 2]]
    z += weights[-1]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def steps(weights: np.ndarray, squares: np.ndarray, features: np.ndarray, target: np.ndarray) -> None:
    """Adagrad steps through a slice's tokens, STEP tokens each; the last row is the bias."""
    for i in range(0, len(target), STEP):
        f, y = features[i : i + STEP], target[i : i + STEP]
        g = np.exp(log_softmax(weights, f))
        g[np.arange(len(y)), y] -= 1
        for c in (*range(f.shape[1]), None):
            if c is None:
                rows, grad = np.array([len(weights) - 1]), g.sum(0, keepdims=True)
            else:
                order = np.argsort(f[:, c], kind="stable")
                sorted_ = f[order, c]
                begin = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                rows, grad = sorted_[begin], np.add.reduceat(g[order], begin, axis=0)
            squares[rows] += grad * grad
            weights[rows] -= RATE * grad / np.sqrt(squares[rows] + 1.0)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    buf, offs = column_bytes(batch.column(column))
    for i, j in slices(offs):
        yield i, j, Words(buf, offs[i : j + 1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, ending, n): a task's words, summed before they leave it."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed(parts):
        h, e, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, e, n = h[order], e[order], n[order]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        return h[begin], e[begin], np.add.reduceat(n, begin) if len(begin) else n[:0]

    def out(parts):
        h, e, n = summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], ["hash", "ending", "n"])

    for batch in batches:
        for _, _, words in _texts(batch, 0):
            held.append(summed([(words.hash(), _ending(words), np.ones(words.count, np.int64))]))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [summed(held)]
                if len(held[0][0]) > 1_000_000:
                    yield out(held)
                    held = []
    if held:
        yield out(held)


@dataclass
class Model:
    table: Table
    weights: np.ndarray
    inside: np.ndarray  # log10 of a listed word's share of its class
    n: int  # training tokens
    v: int  # distinct training tokens
    ends: int
    rare_n: int
    discount: float
    unknown: float  # log10 of the unknown word's share of the rare class


def _frequent(counts: DataFrame) -> int:
    """The least count, 2 or more, that at most TABLE words have; counts are taken in steps of about 9 %, so that what is
    gathered to find it does not grow with the words."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.where("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, words = 2**62, 0
    for r in steps:
        words += r["words"]
        if words > TABLE:
            break
        least = r["least"]
    return least


def learn(training: DataFrame, tables: Tables, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """(model, counts of all words). ``training``: all documents to learn from; null texts are empty. An empty table gives
    a model whose words are all unknown."""
    texts = training.select(text_col)
    counted = texts.mapInArrow(_count, "hash long, ending int, n long").groupBy("hash").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))
    counts = tables.save(counted, "counts")
    ends = training.count()
    s = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
    n, v = (s["n"] or 0) + ends, s["v"] + (ends > 0)
    top = counts.where(F.col("n") >= _frequent(counts)).select("hash", "n", "ending").toArrow()  # at most TABLE rows
    hashes, c, ending = (top.column(x).to_numpy() for x in ("hash", "n", "ending"))
    rank = np.lexsort((hashes, -c))
    hashes, c, symbols = hashes[rank].view(U64), c[rank].astype(np.int64), ending[rank].astype(np.int64)
    symbols[:HEADS] = np.arange(1, len(symbols[:HEADS]) + 1)
    order = np.argsort(hashes)
    table = Table(hashes[order], c[order], symbols[order])
    of_class = np.maximum(np.bincount(table.symbols, table.counts, SYMBOLS), 1)
    inside = np.log10(table.counts / of_class[table.symbols]) if len(c) else np.zeros(0)
    rare_n, rare_v = int((s["n"] or 0) - c.sum()), int(s["v"] - len(c))
    discount = min(max(s["n1"] / max(s["n1"] + 2 * s["n2"], 1), 0.1), 0.95)
    unknown = np.log10(discount * rare_v / rare_n) if rare_n else 0.0
    weights = np.zeros((sum(ROWS) + 1, CLASSES), np.float32)
    for r in range(ROUNDS):
        part = training.where(F.pmod(F.xxhash64(id_col), F.lit(ROUNDS)) == r).select(text_col)
        weights = _round(part, table, weights)
    return Model(table, weights, inside, n, v, ends, rare_n, discount, float(unknown)), counts


def _round(part: DataFrame, table: Table, weights: np.ndarray) -> np.ndarray:
    """The tasks' weights after their steps from ``weights``, averaged by their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares, seen = weights.copy(), np.zeros_like(weights), 0
        for batch in batches:
            for _, _, words in _texts(batch, 0):
                t = tokens(words, table)
                steps(own, squares, t.features, t.target)
                seen += len(t.target)
        if seen:
            moved = np.array_split(own - weights, _CHUNKS)
            salt = TaskContext.get().partitionId() % _SALTS
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([salt] * _CHUNKS, pa.int32()), pa.array([float(seen)] * _CHUNKS), pa.array([m.astype("<f2").tobytes() for m in moved], pa.binary())], ["chunk", "salt", "seen", "part"])

    def mean(got: pa.Table) -> pa.Table:
        seen = got.column("seen").to_numpy()
        total = sum(np.frombuffer(x.as_py(), "<f2").astype(np.float64) * w for x, w in zip(got.column("part"), seen, strict=True)) / seen.sum()
        return pa.table([got.column("chunk")[:1], got.column("salt")[:1], pa.array([seen.sum()]), pa.array([total.astype("<f2").tobytes()], pa.binary())], ["chunk", "salt", "seen", "part"])

    kind = "chunk int, salt int, seen double, part binary"
    got = part.mapInArrow(run, kind).groupBy("chunk", "salt").applyInArrow(mean, kind).groupBy("chunk").applyInArrow(mean, kind).collect()  # _CHUNKS rows
    if not got:
        return weights
    moved = np.frombuffer(b"".join(bytes(r["part"]) for r in sorted(got, key=lambda r: r["chunk"])), "<f2").astype(np.float32)
    return weights + moved.reshape(weights.shape)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        whole = np.log10(model.n + model.v + 1)
        listed_base = np.log10(model.table.counts + 1) - whole
        for batch in batches:
            for i, j, words in _texts(batch, 2):
                t = tokens(words, model.table)
                m = j - i
                place = np.where(t.listed, t.place, 0)
                lp = np.empty(len(t.target))
                for k in range(0, len(lp), 1 << 15):
                    f = t.features[k : k + (1 << 15)]
                    lp[k : k + (1 << 15)] = log_softmax(model.weights, f)[np.arange(len(f)), t.target[k : k + (1 << 15)]]
                lp /= np.log(10)
                end = t.target == 0
                lp += np.where(t.listed, model.inside[place] if len(model.inside) else 0.0, 0.0)
                base = np.where(t.listed, listed_base[place] if len(listed_base) else 0.0, np.log10(model.ends + 1) - whole)
                rare = ~t.listed & ~end
                known = t.listed | (end & (model.ends > 0))
                rows = [np.bincount(t.text, w, m) for w in (np.ones(len(lp)), known, np.where(rare, 0, base), np.where(rare, 0, lp))]
                ids = row + np.arange(i, j)
                # a text's rare words, each once with its number and the sum of its classes' log probabilities
                r = np.flatnonzero(rare)
                order = np.lexsort((t.hashes[r], t.text[r]))
                r = r[order]
                begin = np.flatnonzero(np.r_[True, (t.hashes[r][1:] != t.hashes[r][:-1]) | (np.diff(t.text[r]) != 0)][: len(r)])
                times = np.diff(np.append(begin, len(r)))
                sums = np.add.reduceat(lp[r], begin) if len(begin) else lp[:0]
                k = len(begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(ids), pa.array(ids[t.text[r[begin]]])]),
                        pa.concat_arrays([batch.column(0).slice(i, m).cast(pa.int64()), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([batch.column(1).slice(i, m), pa.nulls(k, pa.bool_())]),
                        pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(t.hashes[r[begin]].view(np.int64))]),
                        pa.array(np.concatenate([rows[0], times]).astype(np.int64)),
                        pa.array(np.concatenate([rows[1], np.zeros(k)]).astype(np.int64)),
                        pa.array(np.concatenate([rows[2], np.zeros(k)])),
                        pa.array(np.concatenate([rows[3], sums])),
                    ],
                    ["row", "id", "held_out", "hash", "times", "known", "base", "lp"],
                )
            row += batch.num_rows

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "held_out") -> DataFrame:
    """(id, flag, n_tokens, n_known, train_tokens, base_score, score) per row; null texts are empty, whose one token is
    the end. ``flag_col``: a boolean column to keep. Repeated rows give rows each; an empty table gives none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(flag_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = tables.save(rows.mapInArrow(_score(model), "row long, id long, held_out boolean, hash long, times long, known long, base double, lp double"), "scored")
    whole = float(np.log10(model.n + model.v + 1))
    rare = scored.where("hash is not null").select("row", "hash", "times", "lp").join(counts.select("hash", F.col("n").alias("c")), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    share = F.when(c > 0, F.log10((c - model.discount) / max(model.rare_n, 1))).otherwise(F.lit(model.unknown))
    rare = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("known_r"), F.sum(F.col("times") * (F.log10(c + 1) - whole)).alias("base_r"), F.sum(F.col("lp") + F.col("times") * share).alias("lp_r"))
    rare = tables.save(rare, "rare")
    out = scored.where("hash is null").join(rare, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("held_out").alias(flag_col), F.col("times").alias("n_tokens"), plus("known", "known_r").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), plus("base", "base_r").alias("base_score"), plus("lp", "lp_r").alias("score"))
