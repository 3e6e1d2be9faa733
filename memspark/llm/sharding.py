"""Sharding by jump consistent hashing (operator 5).

A key's shard follows from the key and the number of shards alone: no ring table, nothing to keep. When shards are
appended, a key either stays or moves to a new shard, and just the necessary fraction moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_start, unused

#: Equal rows that are numbered together.
TOGETHER = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among so many shards; all keys advance together until each has passed the last shard."""
    state, at, after = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = after[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        after[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[after[live] < shards]
    return at.astype(np.int32)


def shards(docs: DataFrame, n: int = 24, key: str = "doc_id") -> DataFrame:
    """docs with shard and grown_shard: where the key is among n and among n + 1 shards. A null key has a shard too;
    equal keys share theirs; a column of docs with one of these names is replaced."""

    @F.pandas_udf("struct<shard:int,grown:int>")
    def apply(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy()
        return pd.DataFrame({"shard": jump(keys, n), "grown": jump(keys, n + 1)})

    (both,) = unused(docs, "both")
    return docs.withColumn(both, apply(F.xxhash64(key))).withColumns({"shard": F.col(f"{both}.shard"), "grown_shard": F.col(f"{both}.grown")}).drop(both)


def slotted(docs: DataFrame, n: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    size is the text's UTF-8 bytes and 8, slot a gapless number from 0 in the shard. A null text counts as empty; rows
    that agree in doc_id and text are counted first and numbered by the thousand, so a key that holds many rows is
    dealt like many keys; other columns aren't looked at; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = shards(each.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__n")), n)
    keyed = cut(counted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((__n - 1) div {TOGETHER} as int)")))), "keys")
    keyed = keyed.withColumn("__n", F.least(F.lit(TOGETHER), F.col("__n") - F.col("__part") * TOGETHER))
    placed = running_start(keyed, "shard", "__n", ["doc_id", "size", "text_crc32", "__part"], "__first", max(16, keyed.count() >> 12))
    slot = F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
