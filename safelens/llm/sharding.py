"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard; no ring table is kept, and one
shard more takes rows only into itself. Positions inside a shard come from block counts,
so no task ever sorts a whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
ROWS_PER_BLOCK = 16384


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key (Lamping and Veach, 2014), for all keys at once."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = jump[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[live] = ((shard[live] + 1) * step).astype(np.int64)
            live = live[jump[live] < shards]
    return shard


def shard_column(key: Column, shards: int) -> Column:
    """Shard number from 0 for ``key`` (any type; all nulls share one shard)."""

    @F.pandas_udf("int")
    def of(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.xxhash64(key))


def with_slots(df: DataFrame, keys: DataFrame, shard: str, block: str, order: list[Column], slot: str) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    ``keys`` has the shard and block of the same rows and little else, so that counting does
    not read the texts. Offsets of blocks come from counts; rows are ordered inside a block only.
    """
    counted = keys.groupBy(shard, block).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(shard, block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    numbered = df.withColumn("__row", F.row_number().over(Window.partitionBy(shard, block).orderBy(*order)))
    out = numbered.join(offsets, [shard, block])
    return out.withColumn(slot, (F.col("__from") + F.col("__row") - 1).cast("long")).drop("__from", "__row", block)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rows_per_block: int = ROWS_PER_BLOCK, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    With ``carry`` all columns of ``docs`` stay, and shard and slot replace columns so named.
    A null text has 0 bytes (size 16, checksum 0); rows with a null doc_id share the shard of the
    null key; repeated rows each get a slot; an empty table gives no rows. Other columns are ignored.
    """
    blocks = common.blocks_for(docs.count(), rows_per_block * shards)
    # Rows without a doc_id share a shard, not a block: only where there are any does counting read texts.
    unnamed = blocks > 1 and docs.filter("doc_id IS NULL").limit(1).count() > 0
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(17)) if unnamed else F.lit(17)
    block = F.pmod(F.xxhash64("doc_id", spread), F.lit(blocks)).cast("int")
    shard = shard_column(F.col("doc_id"), shards)
    keys = docs.select("doc_id", *(["text"] if unnamed else [])).select(shard.alias("__shard"), block.alias("__block"))
    bare = docs.drop("__shard", "__block", "__crc")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    checked = bare.select(*([F.col(c) for c in bare.columns] if carry else ["doc_id"]), F.octet_length(text).cast("long").alias("__bytes"), F.crc32(text).alias("__crc"))
    rows = checked.withColumns({"__shard": shard, "__block": block})
    out = with_slots(rows, keys, "__shard", "__block", [F.col("doc_id"), F.col("__crc"), F.col("__bytes")], "__slot")
    if carry:
        kept = [F.col(c) for c in bare.columns if c not in ("shard", "slot")]
        return out.select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
    return out.select(
        "doc_id",
        (F.col("__bytes") + 16).cast("long").alias("size"),
        F.col("__crc").cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        shard_column(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.read(spark, sf_dir, "documents"))
