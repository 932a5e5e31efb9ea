"""Exact deduplication by grace hashing.

Records are partitioned by a hash of their content, partitions whose distinct content
does not fit the table budget are partitioned again by the next hash, and each bucket
that fits goes through an open-addressing table that compares complete contents. The
spill files are Spark's: the staged contents and the shuffle, both of which survive a
lost executor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fovea.llm.blocks import utf8
from fovea.runtime import shuffle_width, write_stage

#: Distinct content, in bytes, that one table may hold.
TABLE_BYTES = 48 << 20


class ContentTable:
    """Open addressing with linear probing; a slot is taken only by an equal content."""

    def __init__(self, capacity: int = 1024):
        self.slots = np.full(capacity, -1, np.int64)
        self.contents: list[bytes] = []
        self.hashes: list[int] = []

    def _place(self, digest: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = digest & mask
        while (index := int(self.slots[at])) >= 0:
            if content is not None and self.hashes[index] == digest and self.contents[index] == content:
                return at
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        for index, digest in enumerate(self.hashes):
            self.slots[self._place(digest, None)] = index

    def add(self, content: bytes) -> int:
        """Index of the content, a new one if it was not there."""
        digest = xxhash.xxh3_64_intdigest(content)
        at = self._place(digest, content)
        if (index := int(self.slots[at])) >= 0:
            return index
        self.slots[at] = index = len(self.contents)
        self.contents.append(content)
        self.hashes.append(digest)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return index


def _larger(a: int | None, b: int | None) -> bool:
    """a > b, where null is below every number."""
    return a is not None and (b is None or a > b)


def _contents(docs: DataFrame, id_col: str, text_col: str, with_rows: bool) -> DataFrame:
    """One staged row per content and input batch: copies inside a batch meet before any shuffle."""
    others = [f for f in docs.schema.fields if f.name != text_col] if with_rows else []
    row_type = T.StructType(others)
    columns, id_at, text_at = docs.columns, docs.columns.index(id_col), docs.columns.index(text_col)
    kept_at = [columns.index(f.name) for f in others]
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("content", T.BinaryType()),
            T.StructField("sha256", T.StringType()),
            T.StructField("was_null", T.BooleanType()),
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("max_id", T.LongType()),
            T.StructField("best", T.IntegerType()),
            *([T.StructField("row", row_type)] if with_rows else []),
        ]
    )

    def gather(batches):
        chunk = (TaskContext.get().partitionId() + 1) << 31
        for batch in batches:
            if not batch.num_rows:
                continue
            table, rows = ContentTable(), []
            ids = batch.column(id_at).cast(pa.int64()).to_pylist()
            nulls = batch.column(text_at).is_null().to_pylist()
            for i, content in enumerate(utf8(batch.column(text_at))):
                slot = table.add(content)
                if slot == len(rows):
                    rows.append([])
                rows[slot].append(i)
            best = []
            for members in rows:
                top = 0
                for k, i in enumerate(members):
                    if _larger(ids[i], ids[members[top]]):
                        top = k
                best.append(top)
            winners = [members[k] for members, k in zip(rows, best)]
            out = [
                pa.array([chunk] * len(rows), pa.int64()),
                pa.array(range(len(rows)), pa.int32()),
                pa.array(table.contents, pa.binary()),
                pa.array([hashlib.sha256(c).hexdigest() for c in table.contents], pa.string()),
                pa.array([nulls[w] for w in winners], pa.bool_()),
                pa.array([[ids[i] for i in members] for members in rows], pa.list_(pa.int64())),
                pa.array([ids[w] for w in winners], pa.int64()),
                pa.array(best, pa.int32()),
            ]
            if with_rows:
                taken = [batch.column(k).take(pa.array(winners)) for k in kept_at]
                out.append(pa.StructArray.from_arrays(taken, fields=[batch.schema.field(k) for k in kept_at]))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)
            chunk += 1

    staged = docs.mapInArrow(gather, schema)
    return write_stage(staged.withColumn("hash", F.xxhash64("content")), "contents")


def _bucketed(contents: DataFrame, table_bytes: int) -> DataFrame:
    """``contents`` with ``bucket``, partitioned until every bucket fits one table.

    A bucket needs the bytes of its distinct hashes; copies need no more room than one.
    Only a bucket with a single hash can stay over the budget, as one long content.
    """
    spark = contents.sparkSession
    facts = contents.select("hash", F.octet_length("content").alias("n"))
    total = facts.agg(F.sum("n")).first()[0] or 0
    fan_out = max(shuffle_width(spark), -(-total // (table_bytes // 2)))
    level = 0
    bucket = F.pmod(F.xxhash64(F.col("hash"), F.lit(level)), F.lit(fan_out)).cast("string")
    contents = contents.withColumn("bucket", bucket)
    facts = facts.groupBy("hash").agg(F.max("n").alias("n")).withColumn("bucket", bucket)
    while True:
        over = (
            facts.groupBy("bucket")
            .agg(F.sum("n").alias("__bytes"), F.count("*").alias("__hashes"))
            .where((F.col("__bytes") > table_bytes) & (F.col("__hashes") > 1))
            .select(F.col("bucket").alias("__over"), F.ceil(F.col("__bytes") * 2 / F.lit(table_bytes)).alias("__ways"))
        )
        over = write_stage(over, "over")
        if over.isEmpty():
            return contents
        level += 1
        deeper = F.concat_ws("/", "bucket", F.pmod(F.xxhash64(F.col("hash"), F.lit(level)), F.col("__ways")).cast("string"))

        def split(df):
            joined = df.join(over, F.col("bucket") == F.col("__over"), "left")
            return joined.withColumn("bucket", F.when(F.col("__over").isNull(), F.col("bucket")).otherwise(deeper)).drop("__over", "__ways")

        contents, facts = split(contents), split(facts)


def _probe(bucketed: DataFrame, with_rows: bool) -> DataFrame:
    """Run each bucket through a table; rows of a bucket are adjacent after the sort."""
    keep = ["bucket", "chunk", "slot", "content", "max_id", "n"]
    sent = bucketed.withColumn("n", F.size("ids").cast("long"))
    sent = sent.select(*keep, *(["was_null", "row"] if with_rows else []))
    sent = sent.repartition(max(shuffle_width(sent.sparkSession), 1), "bucket").sortWithinPartitions("bucket")
    verdict = [
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
    ]
    if with_rows:
        schema = T.StructType([sent.schema["row"], T.StructField("text", T.StringType()), *verdict])
    else:
        schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("slot", T.IntegerType()), *verdict, T.StructField("wins", T.BooleanType())])

    def close(table, entries, rows):
        """entries: per content, its (max_id, chunk, slot, n, was_null) rows."""
        if not entries:
            return
        wins = []
        for copies in entries:
            top = copies[0]
            for c in copies[1:]:
                if _larger(c[0], top[0]) or (c[0] == top[0] and c[1:3] < top[1:3]):
                    top = c
            wins.append(top)
        sizes = [sum(c[3] for c in copies) for copies in entries]
        if with_rows:
            texts = [None if w[4] else t.decode("utf-8") for w, t in zip(wins, table.contents)]
            row = pa.concat_arrays([rows[w[5]] for w in wins])
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(texts, pa.string()), pa.array([w[0] for w in wins], pa.int64()), pa.array(sizes, pa.int64())],
                names=schema.names,
            )
            return
        flat = [(c[1], c[2], w[0], s, c is w) for copies, w, s in zip(entries, wins, sizes) for c in copies]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*flat), kinds)], names=schema.names)

    def run(batches):
        current, table, entries, rows = None, ContentTable(), [], []
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            facts = zip(*(get[k].to_pylist() for k in keep))
            nulls = get["was_null"].to_pylist() if with_rows else None
            for i, (bucket, chunk, slot, content, max_id, n) in enumerate(facts):
                if bucket != current:
                    yield from close(table, entries, rows)
                    current, table, entries, rows = bucket, ContentTable(), [], []
                index = table.add(content)
                if index == len(entries):
                    entries.append([])
                if with_rows:
                    entries[index].append((max_id, chunk, slot, n, nulls[i], len(rows)))
                    rows.append(get["row"].slice(i, 1))
                else:
                    entries[index].append((max_id, chunk, slot, n, False))
        yield from close(table, entries, rows)

    return sent.mapInArrow(run, schema)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; null counts as empty. The row with the largest
    id stays; null ids are below all others, and of rows equal in id and text exactly one
    stays. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    contents = _contents(docs, "doc_id", "text", with_rows=False)
    verdict = _probe(_bucketed(contents, table_bytes), with_rows=False)
    members = contents.select("chunk", "slot", "ids", "best", "sha256")
    return members.join(verdict, ["chunk", "slot"]).select(
        F.posexplode("ids").alias("__pos", "doc_id"), "keep_id", "group_size", "wins", "best", "sha256"
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("wins") & (F.col("__pos") == F.col("best"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay under the rule of :func:`exact_copies`, with all their columns."""
    contents = _contents(docs, id_col, text_col, with_rows=True)
    kept = _probe(_bucketed(contents, table_bytes), with_rows=True)
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
