"""Shards by jump consistent hashing.

A key and the number of shards decide the shard; there is no table of ranges.
When one shard is appended, a key either stays or moves into the new one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.common import numbered

STEP = 2862933555777941757  # the multiplier of the published generator


def jump(keys, shards: int):
    """The shard of each unsigned 64-bit key (numpy, all keys at once)."""
    import numpy as np

    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(STEP) + np.uint64(1)
        span = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / span)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def key_of(df: DataFrame, column: str) -> Column:
    """Whole numbers are keys as they are; anything else is hashed first.  Null is key 0."""
    kind = df.schema[column].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    key = F.col(column).cast("long") if whole else F.xxhash64(column)
    return F.coalesce(F.when(F.col(column).isNotNull(), key), F.lit(0).cast("long"))


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy("int64").view("uint64"), shards))

    return place(key)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row: size in bytes, shard, slot in the shard, and the shard if one more is added.

    A null text counts as empty (size 1).  Rows with one key share a shard; equal
    rows get slots of their own.  No rows in, no rows out.  Other columns are left
    out, so none can clash.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    sized = docs.select(
        F.col(key).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        key_of(docs, key).alias("_key"))
    placed = sized.select("doc_id", "size", "text_crc32", shard_of(F.col("_key"), shards).alias("shard"),
                          shard_of(F.col("_key"), shards + 1).alias("grown_shard"))
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id") -> None:
    """Write each shard as a folder of its own."""
    docs.withColumn("_shard", shard_of(key_of(docs, key), shards)).write.partitionBy("_shard").parquet(path)
