"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its bytes' four-grams and three-grams over letters, with one mark for any run between letters;
each is hashed to a row of an embedding table, the rows are averaged over the whole text, and a linear softmax gives a
probability per language. Embeddings and softmax are trained together by mini-batch stochastic gradient descent in numpy
on a bounded sample of labelled rows; a temperature is fitted on a part of the sample that training does not see, and
predictions whose calibrated probability is low are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._words import LOWER, PUNCTUATION, column_bytes, slices

#: Bound of the labelled sample: about so many rows of each language.
ROWS = 1500
BUCKETS, WIDTH, EPOCHS, RATE, BATCH = 1 << 15, 16, 6, 1.0, 64
REJECT_SHARE = 0.02


def subwords(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every three- and four-gram of a slice of texts; grams do not reach over a text's end. Bytes of
    ASCII that are no letters or digits count as one mark, digits as another."""
    raw = LOWER[buf[int(offs[0]) : int(offs[-1])]].copy()
    raw[PUNCTUATION[raw]] = 32
    raw[(raw >= 48) & (raw <= 57)] = 48
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    size = np.diff(offs)
    keep[(offs[:-1] - offs[0])[size > 0]] = True  # a text's first mark stays, whatever the text before it ends with
    text = np.repeat(np.arange(len(size)), size)[keep]
    b = raw[keep].astype(np.uint32)
    if len(b) < 3:
        return text[:0], b[:0].astype(np.int64)
    three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    four = three[:-1] | b[3:] << 24
    out_text, out = [], []
    for gram, reach, seed in ((three, 2, 0x9E3779B1), (four, 3, 0x85EBCA6B)):
        same = text[: len(gram)] == text[reach:]
        out_text.append(text[: len(gram)][same])
        out.append(((gram[same] * np.uint32(seed)) >> np.uint32(32 - 15)).astype(np.int64))
    return np.concatenate(out_text), np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages): embedding rows times the softmax's weights
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # calibrated probability under which a prediction is rejected

    def probabilities(self, column: pa.Array) -> np.ndarray:
        buf, offs = column_bytes(column)
        out = np.zeros((len(column), len(self.langs)))
        for i, j in slices(offs):
            text, bucket = subwords(buf, offs[i : j + 1])
            n = np.maximum(np.bincount(text, minlength=j - i), 1)
            for c in range(len(self.langs)):
                out[i:j, c] = np.bincount(text, self.table[:, c][bucket], j - i) / n
        return _softmax((out + self.bias) / self.temperature)


@dataclass
class Example:
    """A labelled text as the distinct buckets of its subwords and how often each occurs."""

    lang: str
    buckets: np.ndarray
    counts: np.ndarray


def _by_bucket(buckets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, sums of their rows)."""
    order = np.argsort(buckets, kind="stable")
    b = buckets[order]
    begin = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
    return b[begin], np.add.reduceat(rows[order], begin, axis=0) if len(b) else rows


def train(examples: list[Example]) -> Model | None:
    """None without labelled text. One language has probability one."""
    examples = [e for e in examples if len(e.buckets)]
    names = sorted({e.lang for e in examples})
    if not names:
        return None
    y = np.array([names.index(e.lang) for e in examples])
    rng = np.random.default_rng(11)
    order = rng.permutation(len(examples))
    held = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    fitted = order[len(held) :]
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    weight = len(fitted) / (len(names) * np.maximum(np.bincount(y[fitted], minlength=len(names)), 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(fitted), max(1, len(fitted) // BATCH)):
            buckets = np.concatenate([examples[r].buckets for r in rows])
            share = np.concatenate([examples[r].counts / examples[r].counts.sum() for r in rows]).astype(np.float32)
            sizes = np.array([len(examples[r].buckets) for r in rows])
            mean = np.add.reduceat(emb[buckets] * share[:, None], np.cumsum(sizes) - sizes, axis=0).astype(np.float64)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            back = (p @ out.T).astype(np.float32)
            out -= 10 * rate * mean.T @ p
            bias -= rate * p.sum(0)
            # rows of the table are rescaled by the batch, as every text's share of a row is small
            own, total = _by_bucket(buckets, np.repeat(back, sizes, axis=0) * share[:, None])
            emb[own] -= np.float32(rate * len(rows) * 10) * total
    model = Model(names, emb.astype(np.float64) @ out, bias)
    if len(held):
        z = np.array([(model.table[examples[x].buckets] * (examples[x].counts / examples[x].counts.sum())[:, None]).sum(0) for x in held]) + bias
        best = []
        for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0):
            p = _softmax(z / t)
            best.append((-np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-12)).mean(), t, float(np.quantile(p.max(1), REJECT_SHARE))))
        _, model.temperature, model.least = min(best)
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, buckets, counts) of whole texts."""
    for batch in batches:
        buf, offs = column_bytes(batch.column(2))
        for i, j in slices(offs):
            text, bucket = subwords(buf, offs[i : j + 1])
            key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
            first = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (key % BUCKETS, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists], ["id", "lang", "buckets", "counts"])


def learn(docs: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on about ROWS rows of each language, chosen by a hash of id and text below the share that gives so many, each
    as the subword counts of its whole text: at most BUCKETS numbers a row, whatever the text's length. ``learn_from``: a
    condition on the id column ``id``. Null languages, ids and texts and empty texts are left out; equal rows count once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text <> ''")
    rows = rows.where(learn_from) if learn_from is not None else rows
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    share = F.pmod(F.xxhash64("id", "text"), F.lit(2**31)) / F.lit(float(2**31))
    some = rows.join(F.broadcast(sizes), "lang").where(share * F.col("n") < ROWS).select("id", "lang", "text").dropDuplicates()
    kind = dict(rows.dtypes)["id"]
    got = some.mapInArrow(_examples, f"id {kind}, lang string, buckets array<int>, counts array<int>").toArrow()
    each = zip(got.column("id").to_pylist(), got.column("lang").to_pylist(), got.column("buckets").combine_chunks(), got.column("counts").combine_chunks(), strict=True)
    ordered = sorted(((lang, str(i), b.values.to_numpy(), c.values.to_numpy()) for i, lang, b, c in each), key=lambda e: (*e[:2], e[2].tobytes(), e[3].tobytes()))
    return train([Example(lang, b, c) for lang, _, b, c in ordered])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred, score (its calibrated probability) and rejected added, from the whole text.

    A text that is null or has no letter is ``und`` with score 0 and rejected, as is every text without a model. A
    rejected prediction keeps its language; of equally likely languages the first in order of names counts. Repeated rows
    come out equal. Existing columns of those names are replaced; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            known = np.array([bool(t) and any(map(str.isalpha, t)) and model is not None for t in texts], bool)
            p = model.probabilities(batch.column(place)) if model is not None else np.zeros((len(texts), 1))
            top = p.argmax(1)
            score = np.where(known, p.max(1), 0.0)
            names = [model.langs[t] if k else "und" for t, k in zip(top, known, strict=True)] if model is not None else ["und"] * len(texts)
            least = model.least if model is not None else 0.0
            new = [pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < least))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
