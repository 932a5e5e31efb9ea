"""Blocks of documents as word hashes, for steps that compare runs of words.

A packed block holds the texts of some documents as one compressed binary, so that a
shuffle of blocks moves compressed text. Words are ``[^\\x20\\x09-\\x0D]+``, which is what
``bytes.split`` splits UTF-8 into.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fovea.llm.blocks import BLOCK_BYTES, block_spans, first_block_id, text_sizes, utf8
from fovea.runtime import write_stage

#: Stands for a null id where ids are compared: larger than all others.
NO_ID = np.iinfo(np.int64).max
# Fixed values of the 64-bit mixing function and the window polynomial.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15


def packed_blocks(docs: DataFrame, id_col: str, text_col: str, with_rows: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Staged frame (block, n_bytes, ids, sizes, nulls, texts[, rows of the other columns])."""
    others = [f for f in docs.schema.fields if f.name != text_col] if with_rows else []
    if not with_rows:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        id_col, text_col = "doc_id", "text"
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    kept_at = [docs.columns.index(f.name) for f in others]
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("nulls", T.ArrayType(T.BooleanType())),
            T.StructField("texts", T.BinaryType()),
            *([T.StructField("rows", T.ArrayType(T.StructType(others)))] if with_rows else []),
        ]
    )

    def pack(batches):
        block, press = first_block_id(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sizes = text_sizes(batch.column(text_at))
            for lo, hi in block_spans(sizes, block_bytes):
                part = batch.slice(lo, hi - lo)
                text = part.column(text_at)
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                out = [
                    pa.array([block], pa.int64()),
                    pa.array([int(sizes[lo:hi].sum())], pa.int64()),
                    one(part.column(id_at).cast(pa.int64()).to_pylist(), pa.int64()),
                    one(sizes[lo:hi].tolist(), pa.int64()),
                    one(text.is_null().to_pylist(), pa.bool_()),
                    pa.array([press.compress(b"".join(utf8(text)))], pa.binary()),
                ]
                if with_rows:
                    struct = pa.StructArray.from_arrays([part.column(k) for k in kept_at], fields=[part.schema.field(k) for k in kept_at])
                    out.append(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), struct))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
                block += 1

    return write_stage(docs.mapInArrow(pack, schema), "blocks")


@dataclass
class Words:
    """The words of a block: one flat sequence, document after document."""

    texts: list[bytes]
    flat: list[bytes]
    lengths: np.ndarray
    doc: np.ndarray  # document number of every word
    number: np.ndarray  # spelling number of every word
    spellings: list[bytes]

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash per word."""
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(w, seed) for w in self.spellings], np.uint64)[self.number] if self.flat else np.zeros(0, np.uint64)

    def whole(self, width: int) -> np.ndarray:
        """Which windows of ``width`` words lie in one document, by their first word."""
        n = max(0, len(self.flat) - width + 1)
        return self.doc[:n] == self.doc[width - 1 : width - 1 + n]


def unpack(texts: bytes, sizes: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(texts)
    ends = np.cumsum([0, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def words_of(texts: list[bytes]) -> Words:
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    number = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    return Words(texts, flat, lengths, np.repeat(np.arange(len(texts)), lengths), number, list(index))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x ^= x >> np.uint64(27)
    x = x * MIX[1]
    x ^= x >> np.uint64(31)
    return x


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """A mixed polynomial hash per window of ``width`` words, by doubling."""
    n = len(word_hash) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    out, done = np.zeros(n, np.uint64), 0
    run, size = mix(word_hash), 1
    while size <= width:
        if width & size:
            out = out * power(size) + run[done : done + n]
            done += size
        if 2 * size <= width:
            run = run[: len(run) - size] * power(size) + run[size:]
        size *= 2
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n = len(values) - width + 1
    if n < 1:
        return values[:0]
    run, size = values, 1
    while 2 * size <= width:
        run = np.minimum(run[: len(run) - size], run[size:])
        size *= 2
    return np.minimum(run[:n], run[width - size : width - size + n])


def pack_numbers(values: np.ndarray, ascending: bool = False, level: int = 1) -> bytes:
    """64-bit numbers byte plane by byte plane, ascending ones as differences, compressed."""
    values = values.astype(np.uint64, copy=False)
    if ascending:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack_numbers(data: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if ascending else values
