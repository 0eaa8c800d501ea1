"""Versions, locked fields and the impact of a change."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.scratch import Tables

#: What separates the terms of a changed value, a fixed value; white space as everywhere.
SEPARATORS = r"""[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}，。；、：,.!?！？;:"“”'‘’（）()《》]+"""
#: How an impact is told, fixed values.
MENTIONS, CHILDREN, BETWEEN = "引用了变更内容：", " 个章节引用了变更内容", "、"
#: The same as Python has it, where \s is more.
_SEPARATORS = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", SEPARATORS[:-1]).replace(r"\s", r" \t\n\x0B\f\r")
_PIECES, _STRETCHES = re.compile(_SEPARATORS.replace("[", "[^", 1) + "+"), re.compile(_SEPARATORS.replace("[", "[^", 1) + "{2,}")
#: Terms of up to so many characters are looked up as runs of stretches. Longer ones are found by one run of so many of
#: their characters, then checked whole; stretches are cut into windows of so many characters for that.
GRAM, WINDOW = 24, 256
#: The sieve that keeps runs which are no term out of a shuffle has a power of two of bits, from these on up to those.
LEAST_BITS, MOST_BITS = 20, 29
#: So many bytes of text are looked through at a time.
PIECE = 300_000
#: So many bytes of text meet their terms at once, so many characters of their words are looked through at a time, and so
#: many pairs of keys and terms are counted at a time.
CHUNK, LAID, PAIRS = 8_000_000, 300_000, 1_000_000
_BASE, _MIX, _AGAIN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many first numbers of both are equal, looked at in steps that double."""
    at, step, end = 0, 16, min(len(a), len(b))
    while at < end:
        apart = np.flatnonzero(a[at : at + step][: end - at] != b[at : at + step][: end - at])
        if len(apart):
            return at + int(apart[0])
        at, step = at + step, 2 * step
    return end


def line_diff(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(kind, line). Runs of equal lines stand for themselves. Where two lines differ, the old one is removed unless the
    new side's next line is it, and the new one added unless the old side's next line is it, which counts first; lines
    that one side has left at the end are removed or added."""
    number = {line: n for n, line in enumerate(dict.fromkeys([*before, *after]))}
    old, new = (np.array([number[x] for x in side] + [-1, -2][k : k + 1]) for k, side in enumerate((before, after)))
    out, i, j = [], 0, 0
    while i < len(before) and j < len(after):
        run = _agreeing(old[i:-1], new[j:-1])
        out += [("same", line) for line in before[i : i + run]]
        i, j = i + run, j + run
        if i < len(before) and j < len(after):
            gone = old[i + 1] == new[j]
            come = not gone and new[j + 1] == old[i]
            out += [("removed", before[i])] * (not come) + [("added", after[j])] * (not gone)
            i, j = i + (not come), j + (not gone)
    return out + [("removed", x) for x in before[i:]] + [("added", x) for x in after[j:]]


def version_pairs(versions: DataFrame, doc: str, revision: str, content: str) -> DataFrame:
    """Each version beside the one before it."""
    w = Window.partitionBy(doc).orderBy(revision)
    return versions.select(doc, revision, F.lag(content).over(w).alias("before"), F.col(content).alias("after")).where("before is not null")


def diffs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, kind, line) of each pair (before, after)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(*k, n, kind, line) for *k, b, a in pdf[[*keys, "before", "after"]].itertuples(index=False) for n, (kind, line) in enumerate(line_diff((b or "").split("\n"), (a or "").split("\n")))]
            yield pd.DataFrame(rows, columns=[*keys, "line_no", "kind", "line"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*keys, "before", "after").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", line_no int, kind string, line string")


def unpivoted(rows: DataFrame, key: str, fields: list[str], value: str) -> DataFrame:
    """(key, field, value) of the columns named."""
    return rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value)) for f in fields))).alias("f")).select(key, "f.*")


def field_changes(before: DataFrame, after: DataFrame, key: str, locks: DataFrame) -> DataFrame:
    """(key, field, before, after, locked) of fields that differ, null as the empty string. ``before`` and ``after``:
    (key, field, value); ``locks``: (key, field)."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), [key, "field"], "full")
    changed = both.select(key, "field", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after")).where("before <> after")
    return changed.join(locks.select(key, "field", F.lit(True).alias("locked")).distinct(), [key, "field"], "left").withColumn("locked", F.coalesce("locked", F.lit(False)))


def merged(changes: DataFrame) -> DataFrame:
    """The changes with ``value``: what a locked field keeps and another takes."""
    return changes.withColumn("value", F.when(F.col("locked"), F.col("before")).otherwise(F.col("after")))


def locks(fields: DataFrame, key: str) -> DataFrame:
    """(key, field, sha256): a lock on each (key, field, value)."""
    return fields.select(key, "field", F.sha2(F.coalesce("value", F.lit("")), 256).alias("sha256"))


def changed_terms(changes: DataFrame, scope: str, order: str) -> DataFrame:
    """(scope, term, place) of the lower-case terms of two characters or more of all changes, before and after: ``place``
    is where a term comes first, by the changes' order and then within the change. A scope keeps projects apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            number, rank, texts = _numbers(batch[scope]), _numbers(batch[order]), list(zip(batch["before"].to_pylist(), batch["after"].to_pylist(), strict=True))
            first = defaultdict(dict)  # by scope: where a piece of the batch comes first, as (row, place in it)
            for row in pc.sort_indices(batch[order], null_placement="at_start").to_pylist():
                seen, before, after = first[number[row]], *texts[row]
                for i, piece in enumerate(dict.fromkeys(_PIECES.findall(before) + _PIECES.findall(after))):
                    at = seen.setdefault(piece, (row, i))
                    if at[1] > i and rank[at[0]] == rank[row]:
                        seen[piece] = row, i
            places = np.array([at for seen in first.values() for at in seen.values()], np.int64).reshape(-1, 2)
            given = batch.select([scope, order]).take(pa.array(places[:, 0]))
            pieces = pa.array([piece for seen in first.values() for piece in seen], pa.string())
            yield pa.RecordBatch.from_arrays([*given.columns, pa.array(places[:, 1].astype(np.int32)), pieces], [scope, order, "i", "piece"])

    kinds = dict(changes.dtypes)
    texts = changes.select(scope, order, *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")))
    each = texts.mapInArrow(run, f"{scope} {kinds[scope]}, {order} {kinds[order]}, i int, piece string")
    each = each.select(scope, order, "i", F.lower("piece").alias("term")).where(F.length("term") >= 2)
    return each.groupBy(scope, "term").agg(F.min(F.struct(order, "i")).alias("place"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _runs(words: list[str], seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 to GRAM: the length, where runs of it begin in the words laid end to end, how many
    characters their words have left there, and a number for each run and its word's seed."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = _codes("".join(words))
    at = np.arange(len(codes))
    left, seeds, total = np.repeat(np.cumsum(sizes), sizes) - at, np.repeat(seeds, sizes), np.zeros(len(codes), np.uint64)
    for n in range(1, GRAM + 1):
        long = left[at] >= n
        at, total = at[long], total[long]
        if not len(at):
            return
        total = total * _BASE + codes[at + n - 1]
        if n > 1:
            yield n, at, left[at], (total ^ seeds[at]) * _MIX


def _bits(numbers: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a number in a sieve of 2 ** power."""
    shift = np.uint64(64 - power)
    return (numbers >> shift).astype(np.int64), (((numbers ^ (numbers >> np.uint64(29))) * _AGAIN) >> shift).astype(np.int64)


def _once(codes: np.ndarray, at: np.ndarray, n: int, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Where the different runs of each row begin: the first of equal numbers, and whatever has its number but other
    characters or another row."""
    _, first, same = np.unique(numbers + rows.astype(np.uint64) * _AGAIN, return_index=True, return_inverse=True)
    other = rows != rows[first][same]
    for k in range(n):
        other |= codes[at + k] != codes[at[first][same] + k]
    return at[np.union1d(first, np.flatnonzero(other))]


def _sieve(terms: DataFrame, scope: str) -> tuple[int, np.ndarray]:
    """(power, bytes): two bits for each (scope, term) of up to GRAM characters. It grows with the terms up to 64 MB, in
    which a run in twenty that is no term comes through at 60 million terms; what comes through is joined exactly."""
    power = min(MOST_BITS, max(LEAST_BITS, int(terms.count()).bit_length() + 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["term"].to_pylist()
            first = np.cumsum([0, *map(len, words)])[:-1]
            for n, at, left, numbers in _runs(words, batch["_seed"].to_numpy().view(np.uint64)):
                whole = (left == n) & np.isin(at, first, assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(numbers[whole], power)))], ["bit"])

    bits = terms.select(F.xxhash64(scope).alias("_seed"), "term").mapInArrow(run, "bit long")
    parts = bits.groupBy(F.call_function("shiftright", F.col("bit"), F.lit(15)).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    sieve = np.zeros((1 << (power - 15), 4096), np.uint8)
    for row in parts.toLocalIterator():  # up to 16,384 rows of 4 KB
        sieve[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return power, sieve.reshape(-1)


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about PIECE bytes of text: many short texts or a few long ones."""
    ends = np.cumsum(pc.binary_length(batch[text]).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // PIECE)) + 1, [batch.num_rows]]))
    return (batch.slice(a, b - a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _texts(table: pa.Table) -> Iterator[str]:
    """The texts of a group, as Python's a few at a time."""
    return (text for batch in table.select(["_text"]).to_batches() for part in _pieces(batch, "_text") for text in part["_text"].to_pylist())


def _laid(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The words in lists of about LAID characters, each with its first one's number."""
    ends = np.cumsum([len(w) for w in words])
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // LAID)) + 1, [len(words)]])).tolist()
    return ((a, words[a:b]) for a, b in pairwise(cuts))


def _buckets(items: DataFrame, scope: str, key: str, tables: Tables) -> Callable[[DataFrame], DataFrame]:
    """What adds ``_bucket`` to rows with scope and key: about CHUNK bytes of the items share one, all rows of a key do. A
    scope of more than a quarter of that has buckets of its own; smaller ones share theirs. Joined are the former alone, four
    for CHUNK bytes at most."""
    sizes = tables.save(items.groupBy(F.col(scope).alias("_scope")).agg(F.sum(F.octet_length("_text").cast("long") + 64).alias("_bytes")), "sizes")
    count = max(1, -(-(sizes.agg(F.sum("_bytes")).first()[0] or 0) // CHUNK))
    large = sizes.where(F.col("_bytes") > CHUNK // 4).select("_scope", F.ceil(F.col("_bytes") / CHUNK).alias("_n"))
    own = F.xxhash64(scope, F.pmod(F.xxhash64(key), F.col("_n")))
    bucket = F.when(F.col("_n").isNull(), F.pmod(F.xxhash64(scope), F.lit(count))).otherwise(own)
    return lambda rows: rows.join(F.broadcast(large), F.col(scope) == F.col("_scope"), "left").withColumn("_bucket", bucket).drop("_scope", "_n")


def _known(items: DataFrame, terms: DataFrame, scope: str) -> DataFrame:
    """(_bucket, scope, term, place) of terms of up to GRAM characters that are a run of a bucket's texts."""
    power, sieve = _sieve(terms, scope)
    sent, kind = items.sparkSession.sparkContext.broadcast(sieve), dict(items.dtypes)[scope]

    def run(group: pa.Table) -> pa.Table:
        sieve, (number, names) = sent.value, _numbered(group[scope])
        seeds = np.zeros(len(names), np.uint64)
        seeds[number] = group["_seed"].to_numpy().view(np.uint64)
        own = [set() for _ in range(len(names))]
        for n, text in zip(number.tolist(), _texts(group), strict=True):
            own[n].update(_STRETCHES.findall(text))
        words, owners = [w for seen in own for w in seen], np.repeat(np.arange(len(own)), [len(seen) for seen in own])
        found = [set() for _ in own]
        for first, laid in _laid(words):
            owner, joined = owners[first : first + len(laid)], "".join(laid)
            codes, each = _codes(joined), np.repeat(owner, [len(w) for w in laid])
            for n, at, _, numbers in _runs(laid, seeds[owner]):
                one, two = _bits(numbers, power)
                there = np.flatnonzero((sieve[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
                two = two[there]
                there = there[((sieve[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)]
                at = _once(codes, at[there], n, each[at[there]], numbers[there])
                for i, k in zip(at.tolist(), each[at].tolist(), strict=True):
                    found[k].add(joined[i : i + n])
        scopes = names.take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
        runs = pa.array([run for f in found for run in f], pa.string())
        return pa.table([pa.repeat(group["_bucket"][0], len(runs)), scopes, runs], names=["_bucket", scope, "term"])

    runs = items.groupBy("_bucket").applyInArrow(run, f"_bucket long, {scope} {kind}, term string")
    return runs.join(terms, [scope, "term"]).select("_bucket", scope, "term", "place")


def _numbered(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A column as numbers of its different values, and those; null is a value."""
    coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _numbers(column: pa.Array) -> list[int]:
    return _numbered(column)[0].tolist()


def _held(words: list[str], owners: np.ndarray, terms: list[str], scopes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, term): pairs of numbers of words and of the terms of up to GRAM characters which stand in them, of the same
    scope. Runs are looked up by their number, then compared; a pair may come more than once."""
    sizes = np.array([len(t) for t in terms], np.int64)
    first, spelt, table = np.cumsum(sizes) - sizes, _codes("".join(terms)), {}
    for n, at, left, numbers in _runs(terms, seeds[scopes]):
        whole = np.flatnonzero(left == n)
        whole = whole[np.isin(at[whole], first, assume_unique=True)]
        whole = whole[np.argsort(numbers[whole], kind="stable")]
        table[n] = numbers[whole], np.searchsorted(first, at[whole])
    pairs = [np.zeros((2, 0), np.int64)]
    for begin, laid in _laid(words):
        owner, codes = np.repeat(np.arange(begin, begin + len(laid)), [len(w) for w in laid]), _codes("".join(laid))
        for n, at, _, numbers in _runs(laid, seeds[owners[begin : begin + len(laid)]]):
            known, term = table.get(n, (numbers[:0], at[:0]))
            if not len(known):
                continue
            low = np.searchsorted(known, numbers)
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == numbers)
            low, here = low[hit], at[hit]
            high = np.searchsorted(known, numbers[hit], "right")
            while len(low):  # more than once if terms share a number, as those with two places do
                found = term[low]
                same = scopes[found] == owners[owner[here]]
                for k in range(n):
                    same &= codes[here + k] == spelt[first[found] + k]
                pairs.append(np.stack([owner[here[same]], found[same]]))
                more = low + 1 < high
                low, here, high = low[more] + 1, here[more], high[more]
    return tuple(np.concatenate(pairs, axis=1))


def _first_of(items: DataFrame, known: DataFrame, scope: str, key: str, first: int) -> DataFrame:
    """(scope, key, terms, n_terms) of items that hold one of their bucket's terms: the ``first`` terms of each key by
    their place, and how many there are; rows that are there again count once. ``known``: (_bucket, scope, term, place), and
    ``_of``, the key if a term is known to be held by that one alone, else null, which ``_own`` tells. A bucket's texts
    look its terms up where they are; no row is made for a mention."""
    place = known.schema["place"].dataType
    places = [f"place.{c}" for c in place.names] if isinstance(place, StructType) else ["place"]
    ranks = [f"_p{i}" for i in range(len(places))]
    known = known.select("_bucket", F.xxhash64(scope).alias("_seed"), scope, "_of", "_own", *(F.col(c).alias(n) for c, n in zip(places, ranks, strict=True)), "term")

    def run(items: pa.Table, known: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in (*ranks, "term", scope)]
        known = known.take(pc.sort_indices(known, order, null_placement="at_start")) if known.num_rows else known
        both = lambda a, b: _numbered(pa.chunked_array([*items[a].chunks, *known[b].chunks], items.schema.field(a).type))
        (number, names), (keyed, _), n = both(scope, scope), both(key, "_of"), items.num_rows
        seeds = np.zeros(len(names), np.uint64)
        seeds[number] = np.concatenate([t["_seed"].to_numpy() for t in (items, known)]).view(np.uint64)
        moved = [np.diff(_numbered(known[c])[0], prepend=-1) != 0 for c in (*ranks, "term", scope)]
        term = np.cumsum(np.logical_or.reduce(moved)) - 1  # the number of a row's term, in the order of places
        _, row, owner = np.unique(number * (keyed.max(initial=0) + 1) + keyed, return_index=True, return_inverse=True)
        own = [{} for _ in range(len(names))]
        words, owners, held = [], [], []
        for k, text in zip(number[:n].tolist(), _texts(items), strict=True):
            seen, mine = own[k], []
            for w in set(_STRETCHES.findall(text)):
                at = seen.get(w)
                if at is None:
                    at = seen[w] = len(words)
                    words.append(w)
                    owners.append(k)
                mine.append(at)
            held.append(np.array(mine, np.int64))
        alone = known["_own"].to_numpy(zero_copy_only=False).astype(bool)
        free = np.flatnonzero(~alone)
        word, found = _held(words, np.array(owners, np.int64), known["term"].take(pa.array(free)).to_pylist(), number[n:][free], seeds)
        # a term that one key alone holds is a word of its own
        alone = np.flatnonzero(alone)
        word, found = np.concatenate([word, len(words) + np.arange(len(alone))]), np.concatenate([term[free][found], term[alone]])
        by = np.argsort(word, kind="stable")
        found, begins = found[by], np.searchsorted(word[by], np.arange(len(words) + len(alone) + 1))
        keys = np.concatenate([np.repeat(owner[:n], [len(h) for h in held]), owner[n:][alone]])
        holds = np.concatenate([*held, len(words) + np.arange(len(alone))])
        by = np.argsort(keys, kind="stable")
        keys, holds = keys[by], holds[by]
        many = np.diff(begins)[holds]
        cuts = np.flatnonzero(np.diff(keys, prepend=-1))  # where a key begins
        cuts = cuts[np.diff(np.concatenate([[0], np.cumsum(many)])[cuts] // PAIRS, prepend=-1) != 0] if len(cuts) else cuts
        parts = []
        for a, b in pairwise([*cuts.tolist(), len(keys)]):
            size = many[a:b]
            at = np.repeat(begins[holds[a:b]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            pairs = np.unique(np.repeat(keys[a:b], size) * (len(term) + 1) + found[at])
            whose, what = np.divmod(pairs, len(term) + 1)
            mine, begin, count = np.unique(whose, return_index=True, return_counts=True)
            near = np.arange(len(pairs)) - np.repeat(begin, count) < first
            parts.append((mine, count, what[near]))
        mine, count, what = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
        example = np.flatnonzero(np.diff(term, prepend=-1))  # a row of each term
        ends = np.concatenate([[0], np.cumsum(np.minimum(count, first))]).astype(np.int32)
        told = pa.ListArray.from_arrays(pa.array(ends), known["term"].take(pa.array(example[what])).combine_chunks())
        given = items.select([scope, key]).take(pa.array(row[mine]))
        return pa.table([*given.columns, told, pa.array(count)], names=[scope, key, "terms", "n_terms"])

    kinds = dict(items.dtypes)
    return items.groupBy("_bucket").cogroup(known.groupBy("_bucket")).applyInArrow(run, f"{scope} {kinds[scope]}, {key} {kinds[key]}, terms array<string>, n_terms long")


def _grams(stretches: DataFrame, keep: list[str], stretch: str) -> DataFrame:
    """(keep, gram): runs of GRAM characters of each stretch. Long stretches go through windows, so that work grows with
    their length."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(stretch) - GRAM + 1), F.lit(WINDOW))
    windows = stretches.select(*keep, F.explode(F.transform(starts, lambda i: F.substring(stretch, i, F.lit(WINDOW + GRAM - 1)))).alias("_window"))
    places = F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.length("_window") - GRAM + 1))
    runs = F.transform(places, lambda i: F.substring("_window", i, F.lit(GRAM)))
    return windows.where(F.length("_window") >= GRAM).select(*keep, F.explode(F.array_distinct(runs)).alias("gram"))


def _long_ones(items: DataFrame, terms: DataFrame, scope: str, key: str, tables: Tables) -> DataFrame:
    """(scope, key, term, place) of terms of more than GRAM characters that an item's ``_text`` holds. The distinct longer
    stretches of a scope are indexed by their runs of GRAM characters; the run of a term that the fewest stretches have
    finds the candidates, which are then checked whole. A term with a run that no stretch has is held by none."""
    cut = F.array_distinct(F.filter(F.split("_text", SEPARATORS), lambda t: F.length(t) > GRAM))
    stretches = tables.save(items.join(terms.select(scope).distinct(), scope, "left_semi").select(scope, key, F.explode(cut).alias("stretch")), "pieces")
    known = tables.save(stretches.select(scope, "stretch").distinct().withColumn("_id", F.monotonically_increasing_id()), "stretches")
    # any run of a term would do; of very long terms the first ones are looked at
    own = F.transform(F.sequence(F.lit(1), F.least(F.length("term") - GRAM + 1, F.lit(WINDOW))), lambda i: F.substring("term", i, F.lit(GRAM)))
    parts = terms.select(scope, "term", "place", F.array_distinct(own).alias("_own"))
    parts = parts.select(scope, "term", "place", F.size("_own").alias("_n"), F.explode("_own").alias("gram"))
    seen = _grams(known, [scope, "_id"], "stretch").join(parts.select(scope, "gram").distinct(), [scope, "gram"], "left_semi")
    seen = tables.save(seen, "grams")
    counted = parts.join(seen.groupBy(scope, "gram").count(), [scope, "gram"]).groupBy(scope, "term", "place", "_n")
    rarest = counted.agg(F.count("*").alias("_has"), F.min(F.struct("count", "gram"))["gram"].alias("gram")).where("_has = _n")
    near = seen.join(rarest.select(scope, "gram", "term", "place"), [scope, "gram"]).drop(scope, "gram")
    sure = known.join(near, "_id").where("contains(stretch, term)").drop("_id")
    return stretches.join(sure, [scope, "stretch"]).select(scope, key, "term", "place")


def mentions(items: DataFrame, terms: DataFrame, scope: str, key: str, haystack: str, first: int = 3, tables: Tables | None = None) -> DataFrame:
    """(scope, key, terms, n_terms, reason) of items whose haystack holds a term of their scope, anywhere and in any case:
    the ``first`` terms by their place, their number, and how that is told.

    A term has no separators, so it stands inside one stretch between separators. Texts are dealt once, in buckets of about
    CHUNK bytes. Every run of up to GRAM characters of a bucket's stretches is a term or not: those that a sieve of all
    terms lets through are joined with the terms once for the bucket, whose texts then look them up. So what is shuffled
    are the texts and the terms of each bucket, not the mentions. Longer terms are found by their rarest run. No scope is a
    group.
    """
    tables = tables or Tables(items.sparkSession)
    texts = items.where(F.col(scope).isNotNull()).select(scope, key, F.lower(F.coalesce(haystack, F.lit(""))).alias("_text"))
    terms = tables.save(terms.select(scope, "term", "place"), "terms")
    bucketed = _buckets(texts, scope, key, tables)
    dealt = bucketed(texts).select("_bucket", F.xxhash64(scope).alias("_seed"), scope, key, "_text")
    known = _known(dealt, terms.where(F.length("term") <= GRAM), scope).withColumn("_of", F.lit(None).cast(texts.schema[key].dataType)).withColumn("_own", F.lit(False))
    long = terms.where(F.length("term") > GRAM)
    if not long.isEmpty():
        alone = bucketed(_long_ones(texts, long, scope, key, tables)).select("_bucket", scope, "term", "place", F.col(key).alias("_of"), F.lit(True).alias("_own"))
        known = known.unionByName(alone)
    found = _first_of(dealt, known, scope, key, first)
    return tables.save(found.withColumn("reason", F.concat(F.lit(MENTIONS), F.array_join("terms", BETWEEN))), "found")


def parent_impact(children: DataFrame, direct: DataFrame, parent: str) -> DataFrame:
    """(parent, reason): what is mentioned itself, or has affected children."""
    counts = children.groupBy(parent).agg(F.count("*").alias("n"))
    both = direct.select(parent, F.col("reason").alias("own")).join(counts, parent, "full")
    return both.select(parent, F.coalesce("own", F.concat(F.col("n").cast("string"), F.lit(CHILDREN))).alias("reason"))


def impact_report(terms: DataFrame, scope: str, volumes: DataFrame, chapters: DataFrame, characters: DataFrame, drafts: DataFrame, match_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """(scope, kind, id, title, reason) of all that changed terms touch. Every table has (scope, id, title, text), text being
    the values that are looked through; chapters and drafts have ``number``, chapters ``volume_id``.

    ``match_keys``: the names of a record's fields by kind ("volume", "chapter", "character"), which then count as
    mentions too, as they do in a record's JSON; none by default. Drafts are plain text and have none.
    """
    tables = Tables(terms.sparkSession)
    terms = tables.save(terms, "changed")  # read for each kind, made once

    def hit(df: DataFrame, kind: str) -> DataFrame:
        names = (match_keys or {}).get(kind, [])
        seen = df.withColumn("text", F.concat_ws(" ", "text", *map(F.lit, names))) if names else df
        return df.drop("text").join(mentions(seen, terms, scope, "id", "text", tables=tables).select(scope, "id", "reason"), [scope, "id"])

    numbered = F.concat(F.lit("第 "), F.coalesce(F.col("number").cast("string"), F.lit("?")), F.lit(" 章 · "), F.col("title"))
    chaptered = hit(chapters, "chapter")
    reasons_ = parent_impact(chaptered.select(F.struct(scope, F.col("volume_id").alias("id")).alias("p")), hit(volumes, "volume").select(F.struct(scope, "id").alias("p"), "reason"), "p")
    owners = volumes.select(F.struct(scope, "id").alias("p"), "title").join(reasons_, "p").select(F.col(f"p.{scope}").alias(scope), "p.id", "title", "reason")
    tag = lambda df, kind, title: df.select(scope, F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), title.alias("title"), "reason")
    out = tag(owners, "volume", F.col("title")).unionByName(tag(chaptered, "chapter", numbered))
    return out.unionByName(tag(hit(characters, "character"), "character", F.col("title"))).unionByName(tag(hit(drafts, "draft"), "draft", numbered))


def remapped_json(payload: Column, old: Column, new: Column) -> Column:
    """A payload's JSON text with one id for another wherever it stands."""
    return F.replace(payload, old, new)


def spliced(content: Column, start: Column, end: Column, rewrite: Column) -> Column:
    """The content with [start, end) replaced."""
    return F.concat(F.substring(content, F.lit(1), start), rewrite, F.substring(content, end + 1, F.length(content)))
