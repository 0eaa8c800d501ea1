"""Spelling variants: words that differ by one edit, found by blocked Gram matrices of letter counts.

A word is a vector of letter counts. One replaced letter moves two words sqrt(2) apart, one inserted letter 1, so only
pairs with a squared distance of at most two can be near; they are read off a product of two blocks of count vectors
and the edit is verified. Blocks are cells: words of one length with equal counts in each of some groups of letters. An
edit changes a cell by one letter more in one group, or by one letter that moves between two groups, so every word
visits those cells too, each pair of cells in one direction, and every near pair meets exactly once. Cells with many
words are dealt into blocks; each pair of blocks is a task's work of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._words import LOWER, column_bytes
from leafmill.llm.resampling import CRC_SQL, crc_sql
from leafmill.scratch import Tables

LEAST_LETTERS, LEAST_COUNT, TIMES, SLIPS = 7, 2, 10, 31
#: Groups of letters that about equally many letters of European texts fall into; letters beyond ASCII by code point.
GROUPS = ["ejq", "tzcm", "aufw", "ogyp", "ikbdl", "nsvrhx"]
#: Words of a block at most, for words of ordinary length.
BLOCK = 4096
_TABLE = LOWER.tobytes()


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_letters: int, slips: int) -> DataFrame:
    """(word, n) of all runs of letters with ``least_letters`` letters or more; of runs whose crc32 with the id is
    divisible by ``slips`` one letter is left out first."""
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % least_letters)

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            buf, offs = column_bytes(batch.column(1))
            for x, name in enumerate(batch.column(0).to_pylist()):
                first = crc32(f"{'' if name is None else name}:".encode())
                found = map(re.Match.group, letters.finditer(buf[offs[x] : offs[x + 1]].tobytes().translate(_TABLE).decode()))
                while runs := list(islice(found, 100_000)):
                    h = np.fromiter(map(crc32, map(str.encode, runs), repeat(first)), np.int64, len(runs))
                    for at in np.flatnonzero(h % slips == 0):
                        word = runs[at]
                        cut = int(h[at]) % len(word)
                        runs[at] = word[:cut] + word[cut + 1 :]
                        if len(word) == least_letters:
                            runs[at] = None
                    counts.update(runs)
                    counts.pop(None, None)
            if len(counts) > 300_000:
                yield flushed(counts)
                counts.clear()
        yield flushed(counts)

    narrow = docs.select(F.col(id_col).cast("string").alias("id"), text_col)
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cells(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(rows, size, cell, visits) of the words' own cells and, a step at a time, of those that they visit: the length of
    the cell's words and their packed counts by group."""
    group = np.arange(256) % len(GROUPS)
    for g, letters in enumerate(GROUPS):
        group[list(map(ord, letters))] = g
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.repeat(np.arange(len(words)) * len(GROUPS), size) + group[letters]
    count = np.bincount(at, minlength=len(words) * len(GROUPS)).reshape(len(words), len(GROUPS))
    unit = 1 << 10 * np.arange(len(GROUPS), dtype=np.int64)
    own, rows = (count % 1024) @ unit, np.arange(len(words))
    yield rows, size, own, False
    for u in unit:  # a longer word with one letter more in that group
        yield rows, size + 1, own + u, True
    for i in range(len(GROUPS)):
        for j in range(i + 1, len(GROUPS)):
            able = np.flatnonzero(count[:, i])
            yield able, size[able], own[able] + unit[j] - unit[i], True


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, own = [], []
        for rows, size, cell, visits in _cells(batch.column(0).to_pylist()):
            key.append(np.column_stack([size, cell]))
            own.append(np.full(len(rows), not visits))
        key, own = np.concatenate(key), np.concatenate(own)
        order = np.lexsort(key.T)
        key, own = key[order], own[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)][: len(key)])
        if len(first):
            yield pa.record_batch([pa.array(x) for x in (key[first, 0].astype(np.int32), key[first, 1], np.add.reduceat(own.astype(np.int64), first), np.diff(np.append(first, len(key))))], ["size", "cell", "own", "n"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, size, cell, visits in _cells(batch.column(0).to_pylist()):
            yield pa.record_batch([pa.array(size.astype(np.int32)), pa.array(cell), pa.array(np.full(len(rows), visits)), *(c.take(pa.array(rows)) for c in batch.columns)], ["size", "cell", "visits", "word", "n"])


def _dealt(words: DataFrame, tables: Tables) -> DataFrame:
    """(size, cell, i, j, visits, word, n): the rows that block i of a cell's own words and block j of its visitors need."""
    even = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    room = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.lit(40 * BLOCK) / F.col("size")))
    sizes = even.mapInArrow(_sizes, "size int, cell long, own long, n long").groupBy("size", "cell").agg(F.sum("own").alias("own"), F.sum("n").alias("n"))
    sizes = sizes.select("size", "cell", F.ceil(F.col("own") / room).cast("int").alias("p"), F.ceil((F.col("n") - F.col("own")) / room).cast("int").alias("q"))
    large = tables.save(sizes.where("p > 1 or q > 1"), "large_cells")  # at most one in BLOCK rows
    placed = even.mapInArrow(_place, "size int, cell long, visits boolean, word string, n long")
    split = placed.join(large, ["size", "cell"], "left").withColumn("h", F.xxhash64("word"))
    # a cell's own word stands in block i against all visitors j, and visits the blocks behind its own
    p, q = F.greatest(F.col("p"), F.lit(1)), F.greatest(F.col("q"), F.lit(1))
    i, j = F.pmod("h", p).cast("int"), F.pmod(F.shiftrightunsigned("h", 20), q).cast("int")
    row = lambda x, y, v: F.struct(x.alias("i"), y.alias("j"), F.lit(v).alias("visits"))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    guest = F.transform(upto(F.lit(0), p - 1), lambda x: row(x, j, True))
    home = F.concat(F.transform(upto(F.lit(0), q - 1), lambda y: row(i, y, False)), F.transform(upto(i + 1, p - 1), lambda x: row(x, j, True)))
    return split.withColumn("to", F.explode(F.when(F.col("visits"), guest).otherwise(home))).select("size", "cell", "to.i", "to.j", "to.visits", "word", "n")


def _counts(letters: np.ndarray, width: int) -> np.ndarray:
    n = len(letters)
    at = np.arange(n)[:, None] * width + letters
    return np.bincount(at.ravel(), minlength=n * width).reshape(n, width)


def _close(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose letter counts have a squared distance of one or two, from blocks of the product.

    (|x|^2, 1, x) . (1, |y|^2, -2 y) is the squared distance, exact in single precision below 2^24.
    """
    kind = np.float32 if max(a.shape[1], b.shape[1]) < 2048 else np.float64
    x, y = _counts(a, width).astype(kind), _counts(b, width).astype(kind)
    left = np.column_stack([(x * x).sum(1), np.ones(len(x), kind), x])
    right = np.column_stack([np.ones(len(y), kind), (y * y).sum(1), -2 * y]).T.copy()
    rows, cols = [], []
    step = max(1, 2_000_000 // max(1, len(y)))
    for at in range(0, len(x), step):
        d = left[at : at + step] @ right
        hit = np.flatnonzero((d <= 2).ravel() & (d > 0).ravel())
        rows.append(hit // len(y) + at)
        cols.append(hit % len(y))
    return np.concatenate(rows), np.concatenate(cols)


def _halves(letters: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and last m letters: one edit leaves one of the two as it is."""
    out = []
    for part in (letters[:, :m], letters[:, letters.shape[1] - m :]):
        h = np.zeros(len(letters), np.uint64)
        for k in range(m):
            h = (h ^ part[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return out[0], out[1]


def _near(a: np.ndarray, b: np.ndarray, width: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart; ``a`` has the letters of words as long as those of ``b`` or one longer. ``itself``:
    a and b are the same words, and every pair counts once."""
    x, y = _close(a, b, width)
    if itself:
        keep = x < y
        x, y = x[keep], y[keep]
    m = (a.shape[1] - 1) // 2
    (a_head, a_tail), (b_head, b_tail) = _halves(a, m), _halves(b, m)
    keep = (a_head[x] == b_head[y]) | (a_tail[x] == b_tail[y])
    x, y = x[keep], y[keep]
    good = np.zeros(len(x), bool)
    step = max(1, 4_000_000 // a.shape[1])
    for at in range(0, len(x), step):
        u, v = a[x[at : at + step]], b[y[at : at + step]]
        if a.shape[1] == b.shape[1]:
            good[at : at + step] = (u != v).sum(1) == 1
        else:
            head = np.logical_and.accumulate(u[:, :-1] == v, 1).sum(1)
            tail = np.logical_and.accumulate((u[:, 1:] == v)[:, ::-1], 1).sum(1)
            good[at : at + step] = head + tail >= v.shape[1]
    return x[good], y[good]


def _best(me: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, near rows, its best near row): the largest n, ties to the smaller row number."""
    order = np.lexsort((other, -n[other], me))
    me, other = me[order], other[order]
    first = np.flatnonzero(np.r_[True, me[1:] != me[:-1]][: len(me)])
    return me[first], np.diff(np.append(first, len(me))), other[first]


def _links(words: list[str], n: np.ndarray, own: int, inside: bool) -> Iterator[tuple]:
    """(row, near rows, best row) arrays of one pair of blocks. The first ``own`` words are the cell's, the others its
    visitors, both in code-point order. ``inside``: pairs of the cell's own words count here."""
    size = len(words[0])
    letters = np.array(words, dtype=f"U{size}").view(np.uint32).reshape(len(words), size)
    alphabet, letters = np.unique(letters, return_inverse=True)  # 0 stands behind shorter words
    letters, width = letters.reshape(len(words), size), len(alphabet)
    length = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.arange(len(words))
    for guests in (own + np.flatnonzero(length[own:] == k) for k in (size, size - 1)):
        if len(guests):
            x, y = _near(letters[:own], letters[guests][:, : length[guests[0]]], width, False)
            if len(x):
                yield _best(x, guests[y], n)
                yield _best(guests[y], x, n)
    if inside:
        x, y = _near(letters[:own], letters[:own], width, True)
        if len(x):
            yield _best(rows[np.r_[x, y]], rows[np.r_[y, x]], n)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the rows of each pair of blocks; rows come sorted by it, a cell's own words first, then by word."""
    names = ["word", "n_near", "form_n", "form"]
    out: list[list] = [[] for _ in names]

    def flushed() -> pa.RecordBatch:
        rows = pa.record_batch([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)
        for x in out:
            x.clear()
        return rows

    def block(parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts)
        own = table.num_rows - int(table.column("visits").to_numpy().sum())
        if own and table.num_rows > 1:
            words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
            for me, near, best in _links(words, n, own, table.column("j")[0].as_py() == 0):
                for x, values in zip(out, ([words[r] for r in me], near.tolist(), n[best].tolist(), [words[r] for r in best]), strict=True):
                    x += values

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[a].tolist())
            if held and now != last:
                block(held)
                held = []
                if len(out[0]) > 50_000:
                    yield flushed()
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        block(held)
    yield flushed()


def near_words(words: DataFrame, tables: Tables) -> DataFrame:
    """(word, n_near, form_n, form): how many words are near each one that has some, and the best of them."""
    block = ["size", "cell", "i", "j"]
    dealt = _dealt(words, tables).repartition(*block).sortWithinPartitions(*block, "visits", "word")
    found = tables.save(dealt.mapInArrow(_meet, "word string, n_near long, form_n long, form string"), "near")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def _roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root) of the words with a form. A form occurs ``TIMES`` as often as its word at least, so forms end."""
    roots = tables.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps that a root stands for
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        roots = tables.save(roots.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.drop("moved")
        roots = roots.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, slips: int = SLIPS, tables: Tables | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words with ``least_letters`` letters and ``least_count`` occurrences.

    Words are runs of ASCII letters and U+00C0 to U+00FF with A-Z in lower case; of a run whose crc32 behind the id is
    divisible by ``slips`` one letter is left out. Words one edit apart are near; a word's form is its most frequent
    near word (ties: the first in code-point order), if that has ``times`` the word's occurrences, and its root the end
    of its forms, or the word itself.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as they stand
    there. Words may be of any length. An empty table gives no rows; other columns are not read.
    """
    tables = tables or Tables(docs.sparkSession)
    words = tables.save(word_counts(docs, id_col, text_col, least_letters, slips).where(F.col("n") >= least_count), "words")
    near = words.join(near_words(words, tables), "word", "left")
    takes = F.col("form_n") >= times * F.col("n")
    near = tables.save(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")), "variants")
    roots = _roots(near.where("form is not null"), tables)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL of the query with this module's parameters: near words share what is left without one letter."""
    return f"""
    with recursive {CRC_SQL}, runs as (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
    each as (select doc_id, run, count(*) as n from runs where length(run) >= {LEAST_LETTERS} group by all),
    hashed as (select run, n, {crc_sql("(doc_id || ':' || run)")} as h from each, crc_table),
    slipped as (select case when h % {SLIPS} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
    words as (select word, sum(n)::bigint as n from slipped where length(word) >= {LEAST_LETTERS} group by word having sum(n) >= {LEAST_COUNT}),
    without as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from words, lateral (select unnest(range(1, length(word) + 1)) as i)),
    pairs as (
        select a.word, b.word as other, b.n from without a join without b on a.i = b.i and a.rest = b.rest and a.word <> b.word
        union select a.word, b.word, b.n from without a join words b on a.rest = b.word
        union select b.word, a.word, a.n from without a join words b on a.rest = b.word),
    best as (select word, count(*) as n_near, max(n) as most from pairs group by word),
    firsts as (select word, min(other) as other, any_value(n_near) as n_near, any_value(most) as most from pairs join best using (word) where n = most group by word),
    forms as (select word, words.n, coalesce(n_near, 0) as n_near, case when most >= {TIMES} * n then other end as form, case when most >= {TIMES} * n then most end as form_n from words left join firsts using (word)),
    walk as (select word, form as root from forms where form is not null union all select walk.word, forms.form from walk join forms on walk.root = forms.word where forms.form is not null),
    ends as (select walk.word, walk.root from walk join forms on walk.root = forms.word where forms.form is null)
    select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join ends using (word)"""
