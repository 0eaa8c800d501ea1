"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from the vocabulary.

The model's pieces are the vocabulary's byte strings written as byte letters, scored by negative rank, with the identity
normaliser, so sentencepiece merges the pair of the lowest rank first, leftmost among equals, as byte-level BPE does.
Pre-tokens are encoded separately; decoding maps each id to its bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as pb2

from leafmill.llm._pretokens import PretokenEncoder, byte_letters, lettered_list, spread
from leafmill.llm._words import released


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece BPE model of a vocabulary; piece i + 1 is the token of the i-th lowest rank, piece 0 is unknown."""
    letters = byte_letters()
    model = pb2.ModelProto()
    model.trainer_spec.model_type = pb2.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(ranks) + 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0.0, type=pb2.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank))
    return model.SerializeToString()


class Codec:
    """Encodes texts to a vocabulary's ranks and decodes ranks to bytes."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.token = {rank: token for token, rank in ranks.items()}
        by_rank = [self.token.get(r, b"") for r in range(max(self.token, default=-1) + 1)]
        self.bytes, self.sizes = np.frombuffer(b"".join(by_rank), np.uint8), np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        of = np.array([0, *sorted(self.token)], np.uint32)
        processor = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        between = byte_letters()[255]

        def pieces(these: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = processor.encode(lettered_list(these).split(between), num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return of[np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))], sizes

        encoder = PretokenEncoder(pattern, pieces)
        self.encode, self.forget = encoder.ids, encoder.reset

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.starts[ids], self.sizes[ids])].tobytes()


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One a worker, as long as the worker lives."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """The rows with the ids of the whole text in ``out_col`` (array<int>; a column of that name is replaced) instead of
    nothing else. Null and empty texts have no ids; an empty table stays empty. ``path`` is a vocabulary file that every
    executor has (the tokenizers' package is installed there)."""
    docs = docs.drop(out_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids, offs = own.encode(batch.column(place))
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out_col])
        own.forget()  # the worker may serve other stages next

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the bytes that the ids stand for in ``out_col``; null ids give none. A column of that name is replaced."""
    rows = rows.drop(out_col)
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codec(path, pattern).decode(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: ids as little-endian unsigned 32-bit integers, and
    the bytes that those ids decode to. Encoding and decoding happen in one pass, so the ids never leave their task."""
    docs = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids, offs = own.encode(batch.column(1))
            each = [ids[i:j] for i, j in zip(offs[:-1], offs[1:], strict=True)]
            hashes = [pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()) for data in ((x.astype("<u4").tobytes() for x in each), map(own.decode, each))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), *hashes], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))]))
