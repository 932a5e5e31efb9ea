"""Documents in blocks of bounded size, the unit that vectorised steps work on.

A block is one row holding the whole rows of some documents. It is staged once, so
every later pass sees the same blocks under the same ids whatever task or attempt
reads them, and a block never straddles two tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fovea.runtime import write_stage

#: Text bytes after which a block ends; one longer document makes a block of its own size.
BLOCK_BYTES = 4 << 20
#: Bytes each row counts besides its text, so that blocks of empty texts end too.
ROW_BYTES = 256


def text_sizes(column) -> np.ndarray:
    """UTF-8 bytes per text; null counts as empty."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def block_spans(sizes: np.ndarray, block_bytes: int) -> list[tuple[int, int]]:
    """Row ranges of consecutive blocks in a batch with these text sizes."""
    if not len(sizes):
        return []
    group = (np.cumsum(sizes + ROW_BYTES) - 1) // block_bytes
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(sizes)]))


def first_block_id() -> int:
    """Ids of the blocks of this task count up from here."""
    return (TaskContext.get().partitionId() + 1) << 31


def blocks(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Staged frame (block long, n_bytes long, rows array<struct<all columns of docs>>).

    No row is dropped and no text cut. An empty table gives no block.
    """
    where = docs.columns.index(text_col)
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("rows", T.ArrayType(docs.schema)),
        ]
    )

    def cut(batches):
        block = first_block_id()
        for batch in batches:
            sizes = text_sizes(batch.column(where))
            struct = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            for lo, hi in block_spans(sizes, block_bytes):
                rows = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), struct.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([int(sizes[lo:hi].sum())], pa.int64()), rows],
                    names=["block", "n_bytes", "rows"],
                )
                block += 1

    return write_stage(docs.mapInArrow(cut, schema), "blocks")


def each_block(batch: pa.RecordBatch):
    """(block id, struct array of its rows, row index) for every block in a batch."""
    ids, rows = batch.column(batch.schema.get_field_index("block")), batch.column(batch.schema.get_field_index("rows"))
    for i in range(batch.num_rows):
        yield ids[i].as_py(), rows[i].values, i


def utf8(column) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def press(values: np.ndarray) -> bytes:
    """An array as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpress(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
