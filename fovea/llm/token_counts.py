"""Token counts from pre-token frequencies.

A document's token count is the sum over its distinct pre-tokens of frequency times
pieces. The frequencies stay where they were counted, packed per block of documents;
only each block's distinct pre-tokens travel, meet once per spelling, get their number
of pieces and travel back as small integers. No token id outlives the pre-token it is of.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fovea.llm.blocks import block_spans, first_block_id, text_sizes
from fovea.llm.tokens import BYTE_BPE, byte_bpe
from fovea.llm.words import pack_numbers, unpack, unpack_numbers
from fovea.runtime import shuffle_width, write_stage

#: Text bytes per block of frequencies.
BLOCK_BYTES = 8 << 20
#: Text bytes per bucket of pre-tokens.
BUCKET_BYTES = 24 << 20

_FREQUENCIES = (
    "block long, n_bytes long, ids array<long>, sizes array<long>, distinct array<int>, which binary, times binary,"
    " spelled binary, spelled_sizes binary"
)
_COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _frequencies(docs: DataFrame, vocabulary: str, block_bytes: int) -> DataFrame:
    """Per block: its documents, their distinct pre-tokens as places in the block's list, and how often each."""

    schema = to_arrow_schema(T.StructType.fromDDL(_FREQUENCIES))

    def count(batches):
        v, block, press = byte_bpe(vocabulary), first_block_id(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sizes = text_sizes(batch.column(1))
            for lo, hi in block_spans(sizes, block_bytes):
                place: dict[str, int] = {}
                distinct, which, times = [], [], []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    found = Counter(v.pretoken_list(text)) if text else {}
                    own = np.array([place.setdefault(p, len(place)) for p in found], np.uint64)
                    order = np.argsort(own)
                    distinct.append(len(found))
                    which.append(np.diff(own[order], prepend=np.uint64(0)))
                    times.append(np.array(list(found.values()), np.uint64)[order])
                spelled = [p.encode() for p in place]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "block": block,
                            "n_bytes": int(sizes[lo:hi].sum()),
                            "ids": batch.column(0).slice(lo, hi - lo).to_pylist(),
                            "sizes": sizes[lo:hi].tolist(),
                            "distinct": distinct,
                            "which": pack_numbers(np.concatenate(which)),
                            "times": pack_numbers(np.concatenate(times)),
                            "spelled": press.compress(b"".join(spelled)),
                            "spelled_sizes": pack_numbers(np.array([len(p) for p in spelled], np.uint64)),
                        }
                    ],
                    schema=schema,
                )
                block += 1

    return write_stage(docs.mapInArrow(count, _FREQUENCIES), "pretokens")


def _pieces(stage: DataFrame, vocabulary: str) -> DataFrame:
    """(block, places, n): pieces of every pre-token of a block, by its place in the block's list.

    A block sends each bucket its pre-tokens of that hash as one row; a bucket encodes each
    spelling once, whatever the number of blocks that sent it.
    """
    total = stage.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(1, int(max(shuffle_width(stage.sparkSession), total / BUCKET_BYTES) - 1).bit_length())
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def send(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for r in batch.to_pylist():
                spelled = unpack(r["spelled"], unpack_numbers(r["spelled_sizes"]).astype(np.int64).tolist())
                bucket = np.array([xxhash.xxh3_64_intdigest(p) >> (64 - bits) for p in spelled], np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                out = []
                for b in np.unique(bucket).tolist():
                    places = order[ends[b] : ends[b + 1]]
                    own = [spelled[i] for i in places]
                    sizes = pack_numbers(np.array([len(p) for p in own], np.uint64))
                    out.append((b, r["block"], pack_numbers(places.astype(np.uint64), True), press.compress(b"".join(own)), sizes))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "block", "places", "spelled", "spelled_sizes"])

    def encode(table: pa.Table) -> pa.Table:
        v = byte_bpe(vocabulary)
        lists = [unpack(s, unpack_numbers(n).astype(np.int64).tolist()) for s, n in zip(table.column("spelled").to_pylist(), table.column("spelled_sizes").to_pylist())]
        once = list(dict.fromkeys(p for own in lists for p in own))
        pieces: dict[bytes, int] = {}
        for at in range(0, len(once), 10_000):
            part = once[at : at + 10_000]
            encoded = v.library.encode_batch([p.decode() for p in part], add_special_tokens=False)
            pieces.update(zip(part, map(len, encoded)))
        n = [pack_numbers(np.fromiter(map(pieces.__getitem__, own), np.uint64, len(own))) for own in lists]
        return pa.table({"block": table.column("block"), "places": table.column("places"), "n": pa.array(n, pa.binary())})

    sent = stage.select("block", "spelled", "spelled_sizes").mapInArrow(send, "bucket int, block long, places binary, spelled binary, spelled_sizes binary")
    return sent.groupBy("bucket").applyInArrow(encode, "block long, places binary, n binary")


def token_counts(
    docs: DataFrame,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = BYTE_BPE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) per row.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each. A null
    id stays null. Other columns are not read. Special strings inside a text count as the
    one token the library makes of them.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stage = _frequencies(docs, vocabulary, block_bytes)
    # A block gets at most one row from each bucket, and no more places than it has pre-tokens.
    back = _pieces(stage, vocabulary).groupBy("block").agg(F.collect_list(F.struct("places", "n")).alias("pieces"))
    facts = stage.drop("spelled", "spelled_sizes", "n_bytes").join(back, "block", "left")

    def total(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["pieces"] or []
                places = [unpack_numbers(p["places"], True).astype(np.int64) for p in parts]
                n = np.zeros(sum(map(len, places)), np.int64)
                for at, p in zip(places, parts):
                    n[at] = unpack_numbers(p["n"]).astype(np.int64)
                steps, times = unpack_numbers(row["which"]).astype(np.int64), unpack_numbers(row["times"]).astype(np.int64)
                ends = np.cumsum(row["distinct"])
                starts = ends - row["distinct"]
                # differences run within a document: take off what the earlier documents summed up to
                run = np.concatenate([[0], np.cumsum(steps)])
                which = run[1:] - np.repeat(run[starts], row["distinct"])
                each = n[which] * times
                sums = np.concatenate([[0], np.cumsum(each)])
                tokens = sums[ends] - sums[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return facts.mapInArrow(total, _COUNTS)
