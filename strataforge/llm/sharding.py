"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataforge.functions.windows import rank_in_order
from strataforge.llm.text import ready
from strataforge.session import staged

SHARDS = 24
MANTISSA = 11  # group sizes that agree in so many leading bits are one size class


def size_class(size: Column, mantissa: int = MANTISSA) -> Column:
    """The size with all but its leading bits cleared; below 2**mantissa sizes are exact."""
    bits = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - (mantissa - 1), F.lit(0)).cast("int")
    # log2 may round up next to a power of two; the class is still a function of the size
    return F.call_function("shiftleft", F.call_function("shiftright", size, bits), bits)


def longest_first(classes: Iterable[tuple[int, int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For classes (size, groups, bytes) from large to small: the groups each shard takes.

    Of equal groups the least-loaded shard takes one after the other.  All
    but the last few of them are counted at once: shard j takes its i-th such group
    when its load is ``load[j] + i * size``, so the groups go to the smallest of
    these loads.  The rest goes through a heap of (load, shard), one by one.
    """
    heap = [(0, s) for s in range(shards)]
    for _, groups, total in classes:
        size = max(1, round(total / groups))
        loads = np.zeros(shards, np.int64)
        for load, s in heap:
            loads[s] = load
        low, high = int(loads.min()), int(loads.min()) + size * groups + 1
        while low + 1 < high:  # the highest level with at most this many groups below
            level = (low + high) // 2
            below = int(np.maximum(0, -(-(level - loads) // size)).sum())
            low, high = (level, high) if below <= groups else (low, level)
        taken = np.maximum(0, -(-(low - loads) // size))
        heap = [(int(loads[s] + taken[s] * size), s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(groups - int(taken.sum())):
            load, s = heap[0]
            taken[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        yield groups, taken.tolist()


def shard_groups(groups: DataFrame, size: str, tie: str, shards: int) -> DataFrame:
    """Add ``shard`` to one row per group, by longest processing time first.

    The driver sees size classes only: at most 2**MANTISSA for each power of two,
    whatever the number of groups.  Groups are ranked by size over the
    cluster, and a group's rank falls into the run its class gave to a shard.
    """
    spark = groups.sparkSession
    with_class = groups.withColumn("_class", size_class(F.col(size)))
    classes = with_class.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    ordered = sorted(((r[0], r.n, r.bytes) for r in classes), reverse=True)
    ends, owners, at = [], [], 0
    for _, taken in longest_first(ordered, shards):
        for s, n in enumerate(taken):
            if n:
                at += n
                ends.append(at)
                owners.append(s)
    runs = spark.sparkContext.broadcast((np.array(ends, np.int64), np.array(owners, np.int32)))
    ranked = rank_in_order(with_class, [], [F.col("_class").desc(), F.xxhash64(tie), F.col(tie)], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, shard_of = runs.value
        for batch in batches:
            ranks = batch.column(1).to_numpy()
            yield pa.record_batch({"key": batch.column(0), "shard": shard_of[np.searchsorted(limits, ranks)]})

    return ranked.select(F.col(tie).alias("key"), "_rank").mapInArrow(place, "key long, shard int")


def assign_shards(docs: DataFrame, doc: str = "doc_id", text: str = "text", shards: int = SHARDS, into: str = "placed") -> DataFrame:
    """(id, struct of size, text_crc32, shard, slot) of every document; equal texts share a shard.

    A document's size is its UTF-8 bytes plus 8.  NULL text counts as empty, so
    NULL and empty texts are one group.  Groups are told apart by a 64-bit hash:
    should two texts ever share it, they merely stay together.  Slots number the
    rows of a shard from 0 by (group, id); equal rows are interchangeable.
    An empty table gives an empty result.  Only ids and sizes are moved, never texts.
    """
    ready(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(doc).alias("doc"),
            (F.octet_length(body).cast("long") + 8).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
        ),
        "sizes",
    )
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    owners = staged(shard_groups(groups, "bytes", "key", shards), "owners")
    placed = rows.join(owners, "key")
    slots = rank_in_order(placed, ["shard"], [F.col("doc").asc_nulls_first(), F.col("key")], "slot")
    result = F.struct("size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
    return slots.select(F.col("doc").alias(doc), result.alias(into))
