"""Jump consistent hashing: stable keys to shards without a ring table, and slots within a shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusaudit.plans.shapes import checkpoint

#: Fixed values of the published hash: the multiplier of its generator, and 2 ** 31.
MULTIPLIER, SCALE = 2862933555777941757, 2147483648.0


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unsigned 64-bit key. From n to n + 1 shards a key stays or moves to shard n."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, at = keys.astype(np.uint64), np.full(len(keys), -1, np.int64)
    target, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(open_):
            at[open_] = target[open_]
            state[open_] = state[open_] * np.uint64(MULTIPLIER) + np.uint64(1)
            chance = ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            target[open_] = ((at[open_] + 1).astype(np.float64) * (SCALE / chance)).astype(np.int64)
            open_ = open_[target[open_] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard column of an integer key column; of any other key give its ``xxhash64``. A null key counts as 0."""
    def assign(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))
    return F.pandas_udf(assign, "int")(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def with_slot(df: DataFrame, group: str, order: list[str], name: str = "slot", few: bool = False) -> DataFrame:
    """Number the rows of every group 0, 1, ... in the given order, without gathering a group in one task.

    Rows are range-partitioned by (group, order) and fixed by a checkpoint, so a large group spans
    many tasks; one row per (partition, group) gives each piece its offset. There are at most as many of these as
    partitions and groups together: where the groups are ``few`` whatever the input, such as shards, they are broadcast; else they meet the rows by an equi-join.
    """
    fixed = checkpoint(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                       .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    pieces = fixed.groupBy(part.alias("_piece"), F.col(group).alias("_group")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_piece", "_group", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = fixed.withColumn("_part", part).join(
        F.broadcast(offsets) if few else offsets, (F.col("_part") == F.col("_piece")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias(name))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every document: (key, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the text's UTF-8 bytes plus 1. A null or empty text has size 1 and crc 0; a null key is
    hashed as 0 and keeps its row. Integer keys are hashed as they are, keys of any other type by their ``xxhash64``. Repeated keys meet in one shard and are numbered by checksum and size; rows equal in
    those get slots in either order, and their output rows are equal but for the slot. Other columns
    play no part, whatever their names. ``grown_shard`` is the place with one shard more.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = F.col(key) if isinstance(docs.schema[key].dataType, IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    sized = docs.select(
        F.col(key).alias(key), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        shard_of(hashed, shards).alias("shard"), shard_of(hashed, shards + 1).alias("grown_shard"))
    placed = with_slot(sized, "shard", [key, "text_crc32", "size"], few=True)
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
