"""Resampling of documents towards a target's word distribution, by hashed n-gram importance weights.

A batch's texts are joined with a sentinel between them and one regular expression finds all words of the batch. A
word's text is found by ``searchsorted`` among the texts' offsets; a run of words whose ends lie in different texts is
masked before ``bincount`` adds up the buckets. Bucket sums are a table of ``buckets`` rows whatever the input, so the
gains are the only thing that goes to every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._words import column_bytes, slices
from leafmill.ranks import ranked
from leafmill.scratch import Tables

SHORTEST, LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 1, 10_000, 2024, 20, 10
#: Lower case for A-Z; all that stands between words becomes a space, so the sentinel occurs nowhere else.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ \n]+")


def _runs(col: pa.Array, shortest: int, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, words by text, text of each feature, bucket of each feature) for slices of a column."""
    buf, offs = column_bytes(col)
    for i, j in slices(offs):
        texts = [buf[offs[x] : offs[x + 1]].tobytes().translate(_PLAIN) for x in range(i, j)]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found = list(_WORD.finditer(b"\n".join(texts)))
        words = list(map(re.Match.group, found))
        text = np.searchsorted(begins, np.fromiter(map(re.Match.start, found), np.int64, len(found)), "right") - 1
        state, owners, sums = list(repeat(0, len(words))), [], []
        for n in range(1, longest + 1):
            if n > 1:  # the run that ends one word further: a space, then that word
                words = words[1:]
                state = list(map(crc32, repeat(b" "), state[: len(words)]))
            state = list(map(crc32, words, state))
            if n >= shortest:
                here = text[: len(state)]
                inside = here == text[n - 1 :]
                owners.append(here[inside])
                sums.append(np.fromiter(state, np.int64, len(state))[inside] % buckets)
        count = np.bincount(text, minlength=j - i) if len(text) else np.zeros(j - i, np.int64)
        yield i, j, count, np.concatenate(owners), np.concatenate(sums)


def bucket_counts(texts: DataFrame, text_col: str = "text", *, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) for the buckets that some feature of the texts falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, sums in _runs(batch.column(0), shortest, longest, buckets):
                total += np.bincount(sums, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): a thousand times the log of the smoothed share in the target over that in the source, floored.
    A row for each of the ``buckets``, also those that neither has."""
    total = lambda df: F.broadcast(df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total")))  # noqa: E731  one row
    spark = source.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = both.crossJoin(total(source).withColumnRenamed("total", "all_s")).crossJoin(total(target).withColumnRenamed("total", "all_t"))
    share = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def weighted(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) per row: ``weight`` is the sum of the gains of its features."""
    table = np.zeros(buckets, np.int64)
    for row in gain.collect():  # one row a bucket
        table[row["bucket"]] = row["gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, count, owner, sums in _runs(batch.column(1), shortest, longest, buckets):
                n = np.bincount(owner, minlength=j - i) if len(owner) else np.zeros(j - i, np.int64)
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, owner, table[sums])  # bincount's weights would be doubles
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(pa.array(x, pa.int64()) for x in (count, n, weight))], ["id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    target_col: str = "text",
    shortest: int = SHORTEST,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    tables: Tables | None = None,
) -> DataFrame:
    """(id, n_features, weight, score, rank) per row of ``docs``; ``rank`` is 1, 2, 3, ... for those that are drawn.

    Words are runs of ASCII letters, ASCII digits and characters beyond ASCII, with A-Z in lower case; features are runs
    of ``shortest`` to ``longest`` words joined by a space, in buckets by crc32. A score is the weight with Gumbel noise
    that depends on ``seed`` and the id alone, so the draw is one without replacement by weight and every run repeats
    it. ``percent`` of the rows with ``least_words`` words are drawn, highest scores first, ties to the smaller id.

    Null and empty texts have no features, a weight of 0 and no rank. A null id counts as empty text in the noise and
    comes last among ties. Repeated rows are rows of their own, with equal scores; which of two equal rows is first is
    not defined. An empty target leaves the smoothed source alone; an empty table gives no rows. Other columns are not
    read. Whole texts count; a text longer than a slice of a batch is a slice of its own.
    """
    tables = tables or Tables(docs.sparkSession)
    shape = {"shortest": shortest, "longest": longest, "buckets": buckets}
    counts = [tables.save(bucket_counts(df, c, **shape), "counts") for df, c in ((docs, text_col), (target, target_col))]
    gain = tables.save(gains(*counts, buckets), "gains")
    rows = weighted(docs, gain, id_col, text_col, **shape)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    rows = tables.save(rows.withColumn("score", F.col("weight") + gumbel), "scores")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    places = ranked(rows.where(able), [F.col("score").desc(), F.col(id_col).asc_nulls_last()], "rank", tables)
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = places.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(id_col, "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB SQL of the query with this module's parameters; crc32 is computed from its polynomial."""
    return f"""
    with {CRC_SQL}, raw as (
        select 's' as side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
        union all
        select 't', null, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
    each as (select side, doc_id, unnest(words) as word from raw),
    counted as (select side, doc_id, word, count(*) as n from each group by all),
    hashed as (select word, {crc_sql("word")} % {BUCKETS} as bucket from (select distinct word from counted), crc_table),
    sums as (select bucket, coalesce(sum(n) filter (side = 's'), 0) as s, coalesce(sum(n) filter (side = 't'), 0) as t from counted join hashed using (word) group by bucket),
    totals as (select sum(s) as all_s, sum(t) as all_t from sums),
    gain as (select bucket, floor(1000 * ln((t + 1)::double * (all_s + {BUCKETS})::double / ((s + 1)::double * (all_t + {BUCKETS})::double)))::bigint as gain from sums, totals),
    weights as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join hashed using (word) join gain using (bucket) where side = 's' group by doc_id),
    scored as (
        select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score
        from documents left join weights using (doc_id)),
    able as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= {LEAST_WORDS})
    select doc_id, n_features, weight, score, case when place <= n * {PERCENT} // 100 then place end as rank from scored left join able using (doc_id)"""


#: The table of the reversed CRC-32 polynomial, as a list of 256 numbers in ``crc_table.crc_t``.
CRC_SQL = "crc_table as (select list(c order by i) as crc_t from (select i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::bigint[]), lambda c, b: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) as c from range(256) r(i)))"


def crc_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes in DuckDB; needs ``CRC_SQL`` among the common table expressions and ``crc_table`` in its FROM."""
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"
