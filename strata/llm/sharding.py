"""Sharding by jump consistent hashing: a key and the number of shards decide, no ring table is kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import number_within, stage

#: The multiplier of the 64-bit linear congruential generator of jump consistent hashing (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: each key leaps to ever later shards and stays at the last one below `shards`."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = np.ascontiguousarray(keys).astype(np.int64).view(np.uint64).copy()
    at, leap = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = leap[moving]
        state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        leap[moving] = np.minimum((at[moving] + 1) * (float(1 << 31) / draw), float(1 << 62)).astype(np.int64)
        moving = moving[leap[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of any key column, from 0 to shards - 1; a null key is a key like any other. Only 8 bytes a row go to Python."""

    @F.pandas_udf("int")
    def jump(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", buckets: int = 512) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of each row; slot is 0, 1, 2 ... within its shard.

    size is the UTF-8 length plus 1 (a null text has none: 1), text_crc32 of a null text that of no bytes: 0. grown_shard
    is the shard with one more shard: either the same or the new one. Rows that repeat a key share its shard and get
    slots of their own. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = rows.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))
    return number_within(stage(rows, "shards"), ["shard"], [key, "size", "text_crc32"], "slot", buckets)


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """docs as Parquet under path/shard=K; a shard is spread over as many files as tasks hold rows of it."""
    docs.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)
