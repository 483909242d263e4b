"""Sharding by jump consistent hashing.

A row's key and the number of shards decide its shard; there is no ring table. With one more shard, a row stays or moves into
the new one, so that only the necessary fraction moves. A row's slot is its place in its shard, gapless from 0: tasks count
their own rows of each shard, and the counts of the tasks before are added, so that no shard is gathered in one place.

Nulls: a null key counts as the empty text, a null text as no bytes with CRC-32 0. Repeated rows share a shard and have slots
of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.llm.common import cut, text_or_empty

SHARDS = 24
OVERHEAD = 8
#: Rows of (task, shard) counts up to which they are broadcast.
MAX_BROADCAST = 200_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: the last jump below ``shards`` of the key's own sequence."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    nxt = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = nxt[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def assign(rows: DataFrame, key_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Adds shard, grown_shard (with one more shard) and slot to the rows. The names of ``rows`` may not begin with two underscores."""
    names = [*rows.columns, "shard", "grown_shard", "__task", "__place"]
    keyed = rows.withColumn("__key", F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit(""))))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            keys = batch.column("__key").to_numpy().view(np.uint64)
            shard, grown = jump(keys, shards), jump(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            place += seen[shard]
            seen += counts
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            more = [pa.array(shard, pa.int32()), pa.array(grown, pa.int32()), pa.array(np.full(len(shard), task), pa.int32()), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=names)

    shape = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "shard int, grown_shard int, __task int, __place long"])
    placed = cut(keyed.mapInArrow(own, shape), "sharded")  # a task's counts stand once they are written
    counts = placed.groupBy("shard", "__task").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("shard", "__task", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")), "shard-starts")
    if starts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        starts = F.broadcast(starts)
    found = placed.join(starts, ["shard", "__task"])
    return found.select(*[f"`{c}`" for c in rows.columns], "shard", (F.col("__start") + F.col("__place")).alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``."""
    raw = text_or_empty().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    return assign(rows, "doc_id", shards)
