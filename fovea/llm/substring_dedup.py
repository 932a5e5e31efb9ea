"""Substring deduplication by relative factors.

Every block of documents is a reference. All windows of ``width`` words are looked up; the
words of windows known in a smaller document become duplicate spans. This lookup replaces
a relative Lempel-Ziv parse: there is no longest match. The factors given beside it are
runs of known windows with the same smallest document, and no removal follows from them.

A factor starts where a window of ``width`` words is known in a reference, so the index of
the references is over windows, and documents and references meet in it instead of block
against block. It is asked in two rounds that both shuffle by hash:

1. Each block sends one short k-gram hash per stretch of text (the smallest one in each
   window, the same in equal windows) and learns which ones another block has too.
2. Only for windows with such a k-gram it sends the full 96-bit hash with its smallest
   document, and learns the smallest document of all blocks, the factor's reference.

A block sends a hash once however many of its documents have it, so a passage of a third
of all documents costs one entry per block.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fovea.llm.blocks import BLOCK_BYTES
from fovea.llm.words import NO_ID, Words, pack_numbers, packed_blocks, sliding_min, unpack, unpack_numbers, window_hashes, words_of
from fovea.runtime import shuffle_width, write_stage

WIDTH = 13
#: Words of the k-gram that stands for a window in the first round.
SEED_WORDS = 5
#: Bits of a k-gram hash that are sent; false meetings only send more to the second round.
SEED_BITS = 48
#: Text bytes per bucket of the index.
BUCKET_BYTES = 24 << 20

_SPANS = "array<struct<start: long, length: long, reference: long>>"


def _bucket_bits(blocks: DataFrame) -> int:
    """Buckets grow with the corpus, so that each holds a bounded share of the index."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, int(max(shuffle_width(blocks.sparkSession), total / BUCKET_BYTES) - 1).bit_length())


def _cut_by_top(values: np.ndarray, bits: int, of: int) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) of ascending numbers of ``of`` bits by their top ``bits``."""
    if not len(values):
        return []
    top = (values >> np.uint64(of - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(top, prepend=-1)).tolist()
    return [(int(top[lo]), lo, hi) for lo, hi in zip(starts, [*starts[1:], len(values)])]


class _Windows:
    """The windows of a block: their place, document, seed and hashes."""

    def __init__(self, words: Words, ids: list[int | None], width: int):
        first = words.hashes(1)
        self.place = np.flatnonzero(words.whole(width))
        self.doc = words.doc[self.place]
        self.id = np.array([NO_ID if i is None else i for i in ids], np.int64)[self.doc] if len(ids) else np.zeros(0, np.int64)
        self.seed = sliding_min(window_hashes(first, SEED_WORDS), width - SEED_WORDS + 1)[self.place] >> np.uint64(64 - SEED_BITS)
        self.high = window_hashes(first, width)[self.place]
        self.words, self.width = words, width

    def entries(self, seeds: np.ndarray) -> "_Entries":
        """The windows to ask for: with a seed of another block, or in two documents of this one."""
        asked = np.zeros(len(self.place), bool)
        if len(seeds) and len(self.seed):
            at = np.minimum(np.searchsorted(seeds, self.seed), len(seeds) - 1)
            asked = seeds[at] == self.seed
        if len(self.high):
            order = np.argsort(self.high, kind="stable")
            h, d = self.high[order], self.doc[order]
            starts = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
            both = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
            asked[order] |= np.repeat(both, np.diff([*starts, len(h)]))
        return _Entries(self, np.flatnonzero(asked))


class _Entries:
    """Distinct 96-bit hashes of the asked windows, ascending, each with its smallest document."""

    def __init__(self, windows: _Windows, asked: np.ndarray):
        low = window_hashes(windows.words.hashes(2), windows.width)[windows.place[asked]] >> np.uint64(32)
        high, ids = windows.high[asked], windows.id[asked]
        order = np.lexsort((ids, low, high))
        self.asked = asked[order]
        high, low, ids = high[order], low[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.key = np.cumsum(new) - 1  # entry of each asked window
        self.high, self.low, self.id = high[new], low[new], ids[new]


def _seeds(blocks: DataFrame, width: int, bits: int) -> DataFrame:
    """(block, seeds): the seeds of each block that another block has too."""

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                w = _Windows(words_of(unpack(r["texts"], r["sizes"])), r["ids"], width)
                seeds = np.unique(w.seed)
                rows = [(b, r["block"], pack_numbers(seeds[lo:hi], True)) for b, lo, hi in _cut_by_top(seeds, bits, SEED_BITS)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int64(), pa.binary()])], names=["bucket", "block", "seeds"])

    def meet(table: pa.Table) -> pa.Table:
        each = [unpack_numbers(s, True) for s in table.column("seeds").to_pylist()]
        every = np.sort(np.concatenate(each))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        out = [(b, pack_numbers(own, True)) for b, s in zip(table.column("block").to_pylist(), each) if len(own := s[np.isin(s, shared, assume_unique=True)])]
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "seeds": pa.array([s for _, s in out], pa.binary())})

    sent = blocks.select("block", "ids", "sizes", "texts").mapInArrow(send, "bucket int, block long, seeds binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, seeds binary")
    return write_stage(met.groupBy("block").agg(F.collect_list("seeds").alias("seeds")), "seeds")


def _all_seeds(parts: list[bytes] | None) -> np.ndarray:
    return np.sort(np.concatenate([unpack_numbers(p, True) for p in parts])) if parts else np.zeros(0, np.uint64)


def _references(asking: DataFrame, width: int, bits: int) -> DataFrame:
    """(block, answers): per entry of a block that a smaller document elsewhere has, that document."""

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                w = _Windows(words_of(unpack(r["texts"], r["sizes"])), r["ids"], width)
                e = w.entries(_all_seeds(r["seeds"]))
                rows = [
                    (b, r["block"], lo, pack_numbers(e.high[lo:hi], True), pack_numbers(e.low[lo:hi]), pack_numbers(e.id[lo:hi].view(np.uint64)))
                    for b, lo, hi in _cut_by_top(e.high, bits, 64)
                ]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "block", "first", "high", "low", "id"])

    def meet(table: pa.Table) -> pa.Table:
        high = [unpack_numbers(x, True) for x in table.column("high").to_pylist()]
        low = np.concatenate([unpack_numbers(x) for x in table.column("low").to_pylist()])
        own = np.concatenate([unpack_numbers(x).view(np.int64) for x in table.column("id").to_pylist()])
        sizes = [len(x) for x in high]
        high = np.concatenate(high)
        order = np.lexsort((own, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        smallest = np.empty(len(order), np.int64)
        smallest[order] = own[order][new][np.cumsum(new) - 1]
        out, at = [], 0
        for block, first, n in zip(table.column("block").to_pylist(), table.column("first").to_pylist(), sizes):
            less = np.flatnonzero(smallest[at : at + n] < own[at : at + n])
            if len(less):
                out.append((block, pack_numbers((less + first).astype(np.uint64), True), pack_numbers(smallest[at : at + n][less].view(np.uint64))))
            at += n
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["block", "entry", "reference"])

    sent = asking.mapInArrow(send, "bucket int, block long, first long, high binary, low binary, id binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, entry binary, reference binary")
    return write_stage(met.groupBy("block").agg(F.collect_list(F.struct("entry", "reference")).alias("answers")), "references")


def factors(known: np.ndarray, reference: np.ndarray, place: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, reference) of known windows whose smallest document is the same; not the longest matches.

    ``place`` are the starts of the known windows, ascending; a factor goes on while the next
    window is known in the same reference, and a new one starts at the border otherwise.
    """
    at, ref = place[known], reference[known]
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(ref) != 0)) + 1
    starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])
    return [(int(at[a]), int(at[b - 1] - at[a]) + width, int(ref[a])) for a, b in zip(starts, ends)]


def _parse(r: dict, width: int):
    """Per document of a block: words, duplicate flags per word, factors."""
    words = words_of(unpack(r["texts"], r["sizes"]))
    w = _Windows(words, r["ids"], width)
    e = w.entries(_all_seeds(r["seeds"]))
    reference = e.id.copy()
    for answer in r["answers"] or []:
        reference[unpack_numbers(answer["entry"], True).astype(np.int64)] = unpack_numbers(answer["reference"]).view(np.int64)
    by_window = np.full(len(w.place), NO_ID, np.int64)
    by_window[e.asked] = reference[e.key]
    known = by_window < w.id
    edge = np.zeros(len(words.flat) + 1, np.int64)
    np.add.at(edge, w.place[known], 1)
    np.add.at(edge, w.place[known] + width, -1)
    removed = np.cumsum(edge[:-1]) > 0
    ends = np.cumsum(words.lengths)
    bounds = np.searchsorted(w.doc, np.arange(len(words.texts) + 1))
    for d, (lo, hi) in enumerate(zip(ends - words.lengths, ends)):
        part = slice(bounds[d], bounds[d + 1])
        yield d, words.flat[lo:hi], removed[lo:hi], factors(known[part], by_window[part], w.place[part] - lo, width)


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, with_rows: bool, block_bytes: int) -> DataFrame:
    blocks = packed_blocks(docs, id_col, text_col, with_rows, block_bytes)
    bits = _bucket_bits(blocks)
    seeds = _seeds(blocks, width, bits)
    answers = _references(blocks.select("block", "ids", "sizes", "texts").join(seeds, "block", "left"), width, bits)
    return blocks.join(seeds, "block", "left").join(answers, "block", "left")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (word start, length, reference id) per row.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller
    id; windows are judged on the input. Null and empty texts have no words. A null id counts
    as larger than all ids and is never a reference for another null one; rows with the same id
    are one document in that none of them is smaller. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for d, flat, removed, found in _parse(r, width):
                    kept = b" ".join(compress(flat, ~removed)) if removed.any() else b" ".join(flat)
                    spans = [{"start": s, "length": n, "reference": ref} for s, n, ref in found]
                    out.append((r["ids"][d], len(flat), int(removed.sum()), hashlib.sha256(kept).hexdigest(), spans))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("reference", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
    return _joined(docs, id_col, text_col, width, False, block_bytes).mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {_SPANS}")


def drop_duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the duplicate spans taken out of the text; all rows and columns stay.

    A text that loses words becomes its kept words joined by one space; any other text is
    left as it is.
    """
    schema = T.StructType([T.StructField("row", T.StructType([f for f in docs.schema.fields if f.name != text_col])), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("rows"))
            plain = batch.drop_columns(["rows"]).to_pylist()
            for i, r in enumerate(plain):
                texts, original = [], unpack(r["texts"], r["sizes"])
                for d, flat, removed, _ in _parse(r, width):
                    text = b" ".join(compress(flat, ~removed)) if removed.any() else original[d]
                    texts.append(None if r["nulls"][d] else text.decode())
                yield pa.RecordBatch.from_arrays([rows[i].values, pa.array(texts, pa.string())], names=["row", "text"])

    out = _joined(docs, id_col, text_col, width, True, block_bytes).mapInArrow(run, schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
