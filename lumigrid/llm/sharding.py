"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

Shard and grown shard depend on the key and the number of shards alone, so appending a
shard moves rows only into it, and only the fraction that it must take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, batch, materialize, task_id


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that keys in sequence start apart."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. Each turn jumps every unfinished key forward, so there are at most ``shards`` turns."""
    state = mix(keys)
    shard = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    while (open_ := ahead < shards).any():
        shard = np.where(open_, ahead, shard)
        state = np.where(open_, state * np.uint64(2862933555777941757) + np.uint64(1), state)
        leap = (shard + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead = np.where(open_, leap.astype(np.int64), ahead)
    return shard.astype(np.int32)


_PLACED = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("grown_shard", pa.int32()), ("task", pa.int64()), ("local", pa.int64())])


def _placer(shards: int):
    def place(batches):
        task, seen = task_id(), np.zeros(shards, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.asarray(b.column("doc_id").fill_null(-1)).view(np.uint64)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            yield batch(_PLACED, b.column("doc_id"), b.column("size"), b.column("text_crc32"), shard, jump_hash(keys, shards + 1), np.full(len(shard), task), local)

    return place


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless from 0 within a shard. They come from a running count inside each task
    plus the task's offset, so no shard's rows ever meet in one task. A null text has size 1
    and the checksum of no bytes; a null id hashes like -1 and stays null. Repeated rows get
    slots of their own. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = materialize(narrow.mapInArrow(_placer(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int, task long, local long"), "shards")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n")).select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = materialize(offsets, "shard-offsets")
    if offsets.count() * 24 <= BROADCAST_BYTES:  # a row per task and shard; beyond the bound the join shuffles
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["task", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("local")).alias("slot"), "grown_shard")
