"""Token ids on disk, Simple-8b coded.

A 64-bit word has a 4-bit selector, which says how many ids of how many bits it packs (Anh and Moffat, 2010), and 60 bits
of ids, the first lowest. Ids go in blocks of BLOCK; a block starts a word, so blocks decode independently and all words
of a segment decode at once. An id of ESCAPE or more is written as ESCAPE and listed beside the words. A segment holds
whole documents and the offset of each of its blocks; a table of segments in document order is the file format.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._pretokens import PretokenEncoder, byte_letters, lettered_list
from leafmill.scratch import Tables

#: Ids a word and bits an id, by selector: fixed values of the format.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 240
ESCAPE = 2**15 - 1
#: A segment closes with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
U64 = np.uint64


def _widest(bits: np.ndarray) -> np.ndarray:
    """The selector of the most ids that fit into a word from each place on. ``bits``: a row a block, zeros behind it."""
    runs, best = {1: bits}, np.full((len(bits), BLOCK), 12, np.int8)
    for s in range(11, -1, -1):
        n, width = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        w = max(runs)
        while w < width:  # the most bits of any two, four ... ids in a row
            runs[2 * w] = np.maximum(runs[w][:, :-w], runs[w][:, w:])
            w *= 2
        most = np.maximum(runs[width][:, :BLOCK], runs[width][:, n - width : n - width + BLOCK])
        best[most <= BITS[s]] = s
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offset of each block in words and their end, escaped ids in order). All blocks are packed in step."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    escaped = ids[ids >= ESCAPE]
    if not n:
        return np.zeros(0, U64), np.zeros(1, np.int64), escaped
    v = np.zeros(blocks * BLOCK, U64)
    v[:n] = np.minimum(ids, ESCAPE)
    bits = np.zeros((blocks, 2 * BLOCK), np.int8)
    bits[:, :BLOCK] = np.frexp(v.astype(np.float32))[1].reshape(blocks, BLOCK)
    selector = _widest(bits).ravel()
    end = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    steps = COUNTS[selector]
    at, live, heads = np.arange(blocks) * BLOCK, np.arange(blocks), []
    while len(live):  # a word of every block that has ids left
        heads.append(at[live])
        at[live] += steps[at[live]]
        live = live[at[live] < end[live]]
    head = np.sort(np.concatenate(heads))
    selector, take = selector[head], np.minimum(steps[head], end[head // BLOCK] - head)
    words, width = selector.astype(U64) << U64(60), BITS[selector].astype(U64)
    for k in range(int(take[width > 0].max(initial=0))):
        some = np.flatnonzero((take > k) & (width > 0))
        words[some] |= v[head[some] + k] << (width[some] * U64(k))
    return words, np.searchsorted(head, np.arange(blocks + 1) * BLOCK), escaped


def unpack(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n ids again; all words at once."""
    selector = (words >> U64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    first = np.zeros(len(offsets) - 1, np.int64)
    first[:] = before[offsets[:-1]] if len(words) else 0
    inside = before - first[block]
    counts = np.minimum(counts, np.minimum(BLOCK, n - block * BLOCK) - inside)
    which = np.repeat(np.arange(len(words)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = BITS[selector].astype(U64)
    ids = (words[which] >> (width[which] * nth.astype(U64))) & ((U64(1) << width[which]) - U64(1))
    ids = ids.astype(np.uint32)
    ids[ids == ESCAPE] = escaped
    return ids


#: Pre-tokens that one call of the library encodes.
_AT_ONCE = 2000


@functools.lru_cache(2)
def _tokenizer(path: str, pattern: str) -> PretokenEncoder:
    """The library's model over pre-tokens that are cut already; a text that holds one of its added tokens goes through
    the library whole, from space to space."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import Split

    own = Tokenizer.from_file(path)
    added = list(own.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added):
        raise ValueError("added tokens that look beyond themselves are not supported")
    bare = Tokenizer(own.model)
    between = byte_letters()[255]
    bare.pre_tokenizer = Split(between, "isolated")
    mark = bare.token_to_id(between)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [lettered_list(pieces[i : i + _AT_ONCE]) for i in range(0, len(pieces), _AT_ONCE)]
        ids = np.concatenate([np.append(np.array(x.ids, np.uint32), np.uint32(mark)) for x in bare.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == mark)
        return ids[ids != mark], np.diff(ends, prepend=-1) - 1

    special = re.compile("|".join(re.escape(t.content) for t in added)) if added else None
    return PretokenEncoder(pattern, encode, special, lambda s: own.encode(s, add_special_tokens=False).ids)


SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("words", T.BinaryType()),
        T.StructField("block_offsets", T.BinaryType()),
        T.StructField("escaped", T.BinaryType()),
        T.StructField("n_ids", T.LongType()),
    ]
)


def _segment(part: int, seq: int, doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    words, offsets, escaped = pack(ids)
    row = [part, seq, doc_ids, [len(x) for x in parts], words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), escaped.astype("<u4").tobytes(), len(ids)]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], SEGMENTS.names)


def write_tokens(docs: DataFrame, tables: Tables, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every whole text with the tokenizers library, append ``end_id``, and write segments in ascending id order.

    Null and empty texts have the end id alone; null ids come first; repeated ids follow one another by a hash of their
    text, so that their rows are split over ranges too. An empty table gives an empty file. ``part`` is the range
    partition, ``seq`` a segment's place in it. Texts are shuffled rather than ids: ids would have to be written first.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = docs.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, doc_ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        encoder = _tokenizer(path, pattern)
        for batch in batches:
            ids, offs = encoder.ids(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                doc_ids.append(doc)
                parts.append(np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id)))
                size += len(parts[-1])
                if size >= SEGMENT_IDS:
                    yield _segment(part, seq, doc_ids, parts)
                    seq, doc_ids, parts, size = seq + 1, [], [], 0
        if parts:
            yield _segment(part, seq, doc_ids, parts)

    return tables.save(ordered.mapInArrow(run, SEGMENTS), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """(part, seq, place, id, size, before, ids_crc32) per document of a written file; ``before``: ids in its segment before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_offsets"], "<u4").astype(np.int64), np.frombuffer(row["escaped"], "<u4"), row["n_ids"])
                ends = np.cumsum(row["sizes"])
                m = len(ends)
                starts = ends - np.array(row["sizes"])
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * m, pa.int32()), pa.array([row["seq"]] * m, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "id", "size", "before", "ids_crc32"],
                )

    return segments.mapInArrow(run, "part int, seq int, id long, size long, before long, ids_crc32 long")


def index(segments: DataFrame) -> DataFrame:
    """(part, seq, start): ids of the file before each segment. One row a segment is summed; parts are numbered in order,
    so only the totals of parts meet in one task."""
    sizes = segments.select("part", "seq", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    ahead = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("ahead"))
    inside = sizes.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    return inside.join(ahead, "part").select("part", "seq", (F.col("ahead") + F.col("inside")).alias("start"))


def token_file_digest(docs: DataFrame, tables: Tables, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, from a file written and read back."""
    segments = write_tokens(docs, tables, path, pattern, id_col, text_col)
    where = tables.save(index(segments), "index")
    return read_tokens(segments).join(where, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("start") + F.col("before")).alias("start"), F.col("size").alias("n_tokens"), "ids_crc32")
