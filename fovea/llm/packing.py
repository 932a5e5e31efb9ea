"""Best-fit packing planned on the histogram of lengths.

The plan is made over counts: best fit decreasing places all items of a length at once
into runs of sequences with the same room, so its work depends on the sequence length
and not on the number of documents. Documents then take the planned places by their
rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.llm.ranking import positions
from fovea.llm.tokens import BYTE_BPE, WordIds, byte_bpe
from fovea.runtime import write_stage

# Fixed value: the id that ends a document.
END_ID = (0).to_bytes(4, "little")

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number of ranks, first sequence, offset).

    Item ``first rank + i`` of a length goes to sequence ``first sequence + i`` at ``offset``.
    Lengths come longest first; an item takes the sequence with the least room that still
    holds it, and a new sequence when there is none.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, number) with that room
    rooms: list[int] = []  # the rooms that have runs, ascending
    plan, opened = [], 0

    def give(room: int, first: int, number: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per_sequence = capacity // length
                # open only as many as this length fills; items of one length share a sequence
                first, number = opened, -(-left // per_sequence)
                opened += number
                give(capacity, first, number)
                continue
            room = rooms[at]
            first, number = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            take = min(number, left)
            plan.append((length, rank, take, first, capacity - room))
            rank, left = rank + take, left - take
            if take < number:
                give(room, first + take, number - take)
            if room > length:
                give(room - length, first, take)
    return plan


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Every document's ids and the end id, cut from the back into pieces of ``capacity``; staged without the ids."""

    def cut(batches):
        words = WordIds(byte_bpe(vocabulary))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview((words(text) if text else b"") + END_ID)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                start, piece = 0, 0
                while start < n:
                    length = capacity if piece else first
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return write_stage(docs.mapInArrow(cut, _PIECES), "pieces")


def pack_documents(
    docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Null and empty texts are one piece of the end id. Only documents over ``capacity`` are cut;
    their first piece takes the remainder. Repeated rows are packed each; of rows with the same
    id the pieces stay apart, as each piece is one row. Other columns are not read. An empty
    table gives no rows. The histogram has at most ``capacity`` rows, the plan at most a few
    for each pair of lengths: both are bounded by ``capacity`` alone.
    """
    pieces = token_pieces(docs, capacity, vocabulary, id_col, text_col)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_plan(counts, capacity)
    if not plan:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = positions(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    by_length: dict[int, list[tuple]] = {}
    for length, *step in plan:
        by_length.setdefault(length, []).append(tuple(step))
    spark = docs.sparkSession
    plan_rows = spark.createDataFrame(
        list(by_length.items()),
        "length long, steps array<struct<first_rank long, n long, first_sequence long, offset long>>",
    )
    step = F.element_at(F.filter("steps", lambda s: (F.col("rank") >= s["first_rank"]) & (F.col("rank") < s["first_rank"] + s["n"])), 1)
    return (
        ranked.join(F.broadcast(plan_rows), "length")
        .withColumn("__step", step)
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("__step.first_sequence") + F.col("rank") - F.col("__step.first_rank")).alias("sequence_id"),
            F.col("__step.offset").alias("offset"),
        )
    )
