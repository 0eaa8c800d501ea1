"""Logs that are folded in order, with a small state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def folded(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], step: Callable, added: list[T.StructField]) -> DataFrame:
    """The rows with the columns ``added``: ``step(state, values of reads) -> (state, values of added)`` along each key's
    rows in order, from a state of None. The sorted log is read in batches; a key and its state are all that is carried
    along, however long its log is. Ties are settled by the other columns."""
    columns = [c for c in rows.columns if c not in keys]
    ordered = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order, *(c for c in columns if c not in order))
    places = [ordered.columns.index(c) for c in reads]
    schema = T.StructType([*ordered.schema.fields, *added])
    kinds = [pa.field(f.name, k) for f, k in zip(added, map(_arrow, added), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            own = zip(*(["NaN" if v != v else v for v in batch.column(k).to_pylist()] for k in range(len(keys))), strict=True)
            found = []
            for key, values in zip(own, zip(*(batch.column(p).to_pylist() for p in places), strict=True), strict=True):
                if key != last:
                    last, state = key, None
                state, out = step(state, *values)
                found.append(out)
            new = [pa.array(list(v), f.type) for v, f in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(f.name for f in kinds)])

    return ordered.mapInArrow(run, schema)


def _arrow(field: T.StructField) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}[field.dataType.simpleString()]
