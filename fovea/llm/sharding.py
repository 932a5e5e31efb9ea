"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.llm.ranking import positions
from fovea.runtime import write_stage

# Multiplier of the published generator, and the key that stands for null.
MULTIPLIER = 2862933555777941757
NULL_KEY = -1


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last jump of its pseudo-random walk below ``n_shards``.

    The walk of a key does not depend on ``n_shards``; one more shard only lets the walks
    that next land exactly there go one step further. No ring, no table.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    nxt = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state)) if n_shards > 0 else np.arange(0)
    with np.errstate(over="ignore"):
        while len(open_):
            shard[open_] = nxt[open_]
            state[open_] = state[open_] * np.uint64(MULTIPLIER) + np.uint64(1)
            step = float(1 << 31) / ((state[open_] >> np.uint64(33)).astype(np.float64) + 1.0)
            nxt[open_] = ((shard[open_] + 1) * step).astype(np.int64)
            open_ = open_[nxt[open_] < n_shards]
    return shard


def jump_shard(key: Column, n_shards: int) -> Column:
    """Column form; a null key counts as the key -1."""

    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64), n_shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(NULL_KEY).cast("long")))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, place in the shard, and the shard after one more is appended, for every row.

    Result: doc_id, size (UTF-8 bytes plus 8), text_crc32, law = 'key', shard, slot, grown_shard.
    Null text: size 8 and the checksum of nothing. Null id: the key -1. Repeated rows go to
    the same shard and take different slots. Equal texts under different ids may part: under
    this law only the id and the number of shards decide. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), n_shards).alias("shard"),
        jump_shard(F.col("doc_id"), n_shards + 1).alias("grown_shard"),
    )
    placed = positions(write_stage(base, "shards"), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
