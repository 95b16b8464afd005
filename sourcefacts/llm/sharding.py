"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import bucket_count, gapless_ranks, materialize

#: Multiplier of the published jump hash generator, and 2**31.
JUMP_MULTIPLIER = 2862933555777941757
JUMP_RANGE = float(1 << 31)
#: Equal rows that are numbered as one; more are several units, spread over tasks.
UNIT_ROWS = 10_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys at once.

    Every key jumps forward through shard counts at random until the next
    jump would leave ``shards``; about ln(shards) rounds for the slowest.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    home = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            moved = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            state[live] = moved
            step = JUMP_RANGE / ((moved >> np.uint64(33)).astype(np.float64) + 1.0)
            target = ((home[live] + 1) * step).astype(np.int64)
            stays = target < shards
            live = live[stays]
            home[live] = target[stays]
    return home


def jump_shard(key: Column, shards: int) -> Column:
    """Column of shard numbers for a long key; a null key counts as 0."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def stable_key(*cols: Column) -> Column:
    """A 64-bit key for keys that are not integers."""
    return F.xxhash64(*cols)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """A shard, a place in it, and the shard after growing by one, for every row.

    Key and shard count alone decide the shard; with one more shard, rows move
    only into the new one. ``size`` is the text's UTF-8 bytes plus
    ``overhead``; a null text has none, and crc 0. Rows that are equal in key,
    size and checksum are counted as one unit before the shuffle and spread
    again at the end by units of at most ``UNIT_ROWS``, so a key that holds a
    third of all rows costs few rows in the shuffle and its rows are made in
    many tasks. Other columns of ``docs`` are not looked at.
    A null key is placed as key 0. Slots follow a hash of the row, so they are
    the same in every run. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    )
    units = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    placed = units.withColumn("shard", jump_shard(F.col("doc_id"), shards)).withColumn("grown_shard", jump_shard(F.col("doc_id"), shards + 1))
    # chunks of a unit: all of UNIT_ROWS but the last, numbered from 0
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / UNIT_ROWS))
    split = placed.select("*", F.explode(chunks).alias("_chunk")).withColumn("_rows", F.least(F.lit(UNIT_ROWS).cast("long"), F.col("_n") - F.col("_chunk") * UNIT_ROWS))
    split = materialize(split, "shards")
    ranked = gapless_ranks(split, ["shard"], ["doc_id", "text_crc32", "size", "_chunk"], "_rows", bucket_count(split.count()), "_first")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_rows") - 1)).alias("slot"),
        "grown_shard",
    )
