"""Rows of a series on their way through a stateful operator: runs of them in one value each, as Arrow.

Spark calls a stateful processor once for each series and micro-batch; rows that come one by one, or as a pandas frame, cost that call several times what the steps do.
So rows are gathered by series first, a processor gets and gives record batches, and rows are spread out again after it. A piece holds at most ``PIECE`` rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

#: Rows of a piece, and bytes that are gathered for pieces to be made, at most.
PIECE, GATHER = 65_536, 32 << 20
#: Rows of a batch that pieces are spread out into, more if a piece has more.
SPREAD = 16_384
#: The column of pieces.
ROWS = "_rows"


def cast(columns: Iterable[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def join(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def read(piece: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(piece), schema)


def ordered(b: pa.RecordBatch, order: Sequence[str]) -> pa.RecordBatch:
    """Sorted, equal rows as they came; nulls last."""
    return b.take(pc.sort_indices(b, sort_keys=[(c, "ascending") for c in order])) if b.num_rows > 1 else b


def _codes(c: pa.Array) -> np.ndarray:
    return c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def gathered(df: DataFrame, keys: Sequence[str], schema: pa.Schema) -> DataFrame:
    """Rows (keys, _rows): the pieces of each series that lie together in a partition."""
    keys = list(keys)

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        codes = [_codes(c) for c in own]
        by = np.lexsort(codes[::-1]) if codes else np.arange(batch.num_rows)  # stable: rows of a series stay as they came
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in codes:
            new[1:] |= c[by][1:] != c[by][:-1]
        first = np.flatnonzero(new)
        ends = np.append(first[1:], batch.num_rows)
        rows = cast(batch.columns, schema).take(pa.array(by))
        cuts = [(i, at, min(at + PIECE, hi)) for i, (lo, hi) in enumerate(zip(first.tolist(), ends.tolist())) for at in range(lo, hi, PIECE)]
        begin = pa.array(by[first[[i for i, _, _ in cuts]]])
        pieces = pa.array([rows.slice(lo, hi - lo).serialize().to_pybytes() for _, lo, hi in cuts], pa.binary())
        yield pa.RecordBatch.from_arrays([*[c.take(begin) for c in own], pieces], names=[*keys, ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= GATHER:
                yield from made(join(held))
                held, size = [], 0
        if held:
            yield from made(join(held))

    out = T.StructType([*[df.schema[k] for k in keys], T.StructField(ROWS, T.BinaryType())])
    return (df.repartition(*keys) if keys else df.coalesce(1)).mapInArrow(run, out)


def spread(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of pieces."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for piece in b.column(0):
                held.append(pa.ipc.read_record_batch(piece.as_buffer(), arrow))
                n += held[-1].num_rows
                if n >= SPREAD:
                    yield join(held)
                    held, n = [], 0
            if held:
                yield join(held)

    return df.mapInArrow(run, schema)


class PieceProcessor(StatefulProcessor):
    """A stateful processor over record batches: ``handle(rows)`` gets all rows of a series in a micro-batch and gives batches of the schema ``made``."""

    def __init__(self, read: T.StructType, made: T.StructType):
        self.read, self.made = to_arrow_schema(read), to_arrow_schema(made)

    def handle(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        named = Row(ROWS)
        for b in self.handle(join([read(r[-1], self.read) for r in rows])):
            for at in range(0, b.num_rows, PIECE):
                yield named(cast(b.slice(at, PIECE).columns, self.made).serialize().to_pybytes())

    def close(self) -> None:
        pass


def transform(df: DataFrame, keys: Sequence[str], processor: PieceProcessor, schema: T.StructType, **how) -> DataFrame:
    """``df`` through the processor, one state for each series."""
    pieces = gathered(df, keys, processor.read)
    out = pieces.groupBy(*keys).transformWithState(processor, outputStructType=T.StructType([T.StructField(ROWS, T.BinaryType())]), outputMode="Append", timeMode="None", **how)
    return spread(out, schema)
