"""Toxicity by compression distance.

Two zstandard dictionaries are learned from labelled text: one of ordinary windows (zstandard's own trainer), one of the
stretches that set toxic text apart. Every text is cut into windows of whole words; a window is compressed once with
the ordinary dictionary alone and once with the toxic one before it, so ordinary text costs the same twice and toxic
text costs less the second time. How many of a text's windows save how many bytes goes through a logistic calibration
fitted on the labels, whose 0.5 is the decision.

The toxic dictionary is raw content chosen by document log-odds, not by zstandard's trainer: the trainer ranks segments
by frequency, so it fills up with ordinary syllables (figures in the README).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._words import Words, column_bytes, mix, released, shingles, slices

#: Bounds of the labelled sample: rows of either label, the smallest by hash of id, characters of one row and of all of
#: either label.
TOXIC_ROWS, ORDINARY_ROWS, ROW_CHARS, SAMPLE_CHARS = 3000, 6000, 200_000, 20_000_000
#: What the toxic dictionary has room for, as the ordinary one.
TOXIC_BYTES = 112 * 1024
WINDOW, ORDINARY_BYTES = 80, 112 * 1024
#: Matches from four bytes on, all candidates followed: what a dictionary knows is found whatever else it holds.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY2, "window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 6, "min_match": 4, "target_length": 16}
STEPS = (1, 2, 3, 4, 5)


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Consecutive pieces of lower-cased UTF-8, cut after the first space from ``size`` on; a longer word is cut at twice
    ``size``. They cover the whole text; an empty text has none."""
    data, out, i = text.lower().encode(), [], 0
    n = len(data)
    while i < n:
        j = i + size
        if j < n:
            k = data.find(b" ", j, j + size)
            j = k + 1 if k >= 0 else j + size
        out.append(data[i:j])
        i = j
    return out


def _fragments(text: str) -> set[str]:
    """Starts of the text's words, from four characters to the whole word and the space behind it."""
    return {w[:k] for w in {f"{w} " for w in re.findall(r"\w{4,}", text.lower())} for k in range(4, min(len(w), 16) + 1)}


def toxic_roots(toxic: list[str], ordinary: list[str]) -> list[str]:
    """The word starts in at least 1 % and five of the toxic texts, twenty times as often as in the ordinary ones; each
    as long as nearly all of its occurrences agree."""
    seen = Counter()
    for t in toxic:
        seen.update(_fragments(t))
    p, n = len(toxic), max(len(ordinary), 1)
    often = {f: c for f, c in seen.items() if c >= max(5, 0.01 * p)}
    clean = Counter()
    for t in ordinary:
        clean.update(f for f in _fragments(t) if f in often)
    apart = {f for f, c in often.items() if c / p > 20 * (clean[f] + 1) / n}
    out = set()
    for f in (f for f in apart if not any(f[:k] in apart for k in range(4, len(f)))):
        while longer := [g for g in apart if len(g) == len(f) + 1 and g.startswith(f) and seen[g] >= 0.8 * seen[f]]:
            f = longer[0]
        out.add(f)
    return sorted(out)


def toxic_content(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """What the toxic dictionary adds: the toxic texts' words with such a start, most frequent last, where matches are
    cheapest. And what the ordinary one gets for it: the same words without their starts, so that endings which ordinary
    words share save nothing."""
    roots = tuple(toxic_roots(toxic, ordinary))
    words = Counter(w for t in toxic for w in re.findall(r"\w{4,}", t.lower()) if f"{w} ".startswith(roots)) if roots else Counter()
    often, room = [], TOXIC_BYTES
    for w in sorted(words, key=lambda w: (-words[w], w)):
        if (room := room - len(w.encode()) - 2) < 0:
            break
        often.insert(0, w)
    ends = [f"{w} "[max(len(r) for r in roots if f"{w} ".startswith(r)) :] for w in often]
    return "".join(f" {w} " for w in often).encode(), " ".join(ends).encode()


def _unlike(texts: list[str]) -> list[str]:
    """One of each group of near copies: texts whose smallest hash of three words is new."""
    col = pa.array(texts, pa.large_string())
    buf, offs = column_bytes(col)
    kept, found = [], set()
    for i, j in slices(offs):
        words = Words(buf, offs[i : j + 1])
        h, first = shingles(words.hash(), words.first, 3)
        h = mix(h)
        for x in range(j - i):
            least = h[first[x] : first[x + 1]].min(initial=2**64 - 1)
            if least not in found:
                found.add(least)
                kept.append(texts[i + x])
    return kept


@dataclass
class Model:
    """Both dictionaries' contents and the calibration; ``base`` is the score where no model could be fitted."""

    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    base: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        def one(content: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            known.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=known, compression_params=how)

        return [one(self.ordinary), one(self.toxic + self.ordinary)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        plain, marked = (c.compress for c in self.compressors())
        rows = np.zeros((len(texts), len(STEPS) + 3))
        for x, text in enumerate(texts):
            cut = windows(text or "")
            before = np.array([len(plain(w)) for w in cut], float)
            saved = before - np.array([len(marked(w)) for w in cut], float)
            rows[x] = [max(len(cut), 1), saved.sum(), *((saved >= k).sum() for k in STEPS), (saved < 0).sum()]
        n, counts = rows[:, :1], rows[:, 2:-1]
        return np.hstack([rows[:, 1:] / n, np.sqrt(counts / n), np.log1p(counts), np.log1p(n)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def _dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    pieces = [w for t in ordinary for w in windows(t)]
    try:
        content = zstandard.train_dictionary(ORDINARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        content = b"".join(pieces)[-ORDINARY_BYTES:]
    added, control = toxic_content(toxic, ordinary)
    return Model(control + content, added)


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """``share``: of toxic rows among all labelled ones, which the sample need not keep. The calibration sees each text's
    features by dictionaries that were learned without it: from the other half of the texts."""
    toxic, ordinary = _unlike(toxic), _unlike(ordinary)
    if len(toxic) < 2 or len(ordinary) < 2 or sum(map(len, ordinary)) < 100 * WINDOW:
        return Model(base=share)
    parts = []
    for half in (0, 1):
        model = _dictionaries(toxic[1 - half :: 2], ordinary[1 - half :: 2])
        parts += [(model.features(toxic[half::2]), 1.0), (model.features(ordinary[half::2]), 0.0)]
    x = np.concatenate([f for f, _ in parts])
    y = np.concatenate([np.full(len(f), label) for f, label in parts])
    model = _dictionaries(toxic, ordinary)
    weight = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = 1e-3 * np.eye(len(w))
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (weight * (p - y)) + ridge @ w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        w -= np.linalg.solve(bend, slope)
    model.weights = w
    return model


def learn(docs: DataFrame, labels: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows: of either label those with the smallest hash of their id among the texts
    of up to ROW_CHARS characters, at most TOXIC_ROWS and ORDINARY_ROWS of them and SAMPLE_CHARS characters together. ``learn_from``:
    a condition on the id column ``id``. An id labelled twice counts as toxic if one label says so, an id with several
    texts has the least of them; null labels and ids and null and empty texts are left out."""
    known = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(toxic_col) > 0).alias("toxic"))
    known = known.where(learn_from) if learn_from is not None else known
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(True, 0) / max(sum(counts.values()), 1)
    some = [known.where(c).orderBy(F.xxhash64("id"), "id").limit(n) for c, n in (("toxic", TOXIC_ROWS), ("not toxic", ORDINARY_ROWS))]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(f"text <> '' and length(text) <= {ROW_CHARS}")
    rows = texts.join(F.broadcast(some[0].union(some[1])), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id"))  # over the sample's rows
    got = rows.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).select("id", "toxic", "text").orderBy("id").collect()
    return fit([r["text"] for r in got if r["toxic"]], [r["text"] for r in got if not r["toxic"]], share)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``score`` (0 to 1, higher: likelier toxic) of the whole text added. Null texts count as empty; repeated
    rows give equal scores; an existing column of that name is replaced; an empty table stays empty."""
    docs = docs.drop("score")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = model.scores(batch.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
