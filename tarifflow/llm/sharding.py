"""Sharding by longest processing time: groups of equal texts, largest first, each to the least-loaded shard.

A row's size is its text's bytes and a fixed number more; a group's is that of its rows.
The heap of shard loads needs no group, only how many have each size: groups of one size
go round the shards in an order that changes when a fuller shard joins.  So one task
reads the distinct group sizes, largest first, at most 2 * sqrt(bytes of all) of them,
with the heap as its only state, and writes for each size the orders and the ranks from
which they hold.  Groups then find their shard by their rank among those of their size,
which is a window over parts of the size with the counts of earlier parts added.  All
else is grouping and joins of narrow rows; texts are read once and never shuffled.

Law `bytes`: no shard exceeds the mean by more than the smallest group in it, and none
can do better with a group larger than the mean, which must stay together.

Defined results: a null text counts as empty and is in one group with empty ones.  Groups
of equal size go by the md5 of their text; loads that are equal by shard number.  Slots
of a shard go by doc_id, nulls first, then md5.  Repeated rows each have a slot.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARDS, ROW_BYTES = 24, 8
#: Groups of one part of a size, and equal rows that are numbered at once.
PART_GROUPS, COPIES = 1 << 16, 1 << 16

_TURNS = "array<struct<first: bigint, shards: array<int>>>"


def deal(heap: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Place `count` groups of `size` on a heap of (load, shard), which changes.

    (first rank, shards): from that rank on, these shards get one after the other, again and again.
    """
    if count <= len(heap) or size == 0:
        placed = []
        for _ in range(count if size else 1):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            placed.append(shard)
        return [(0, placed)]
    turns, rank = [], 0
    while rank < count:
        order = sorted(heap)
        load, shard = order[0]
        # those that get a group before the first gets its second
        members = [x for x in order if x < (load + size, shard)]
        rounds = (count - rank) // len(members)
        if len(members) < len(order):
            other, number = order[len(members)]
            rounds = min(rounds, (other - load) // size - ((other - load) % size == 0 and number < shard))
        last = members[: count - rank] if rounds == 0 else []
        turns.append((rank, [i for _, i in members]))
        rank += rounds * len(members) + len(last)
        heap[:] = [(n + size * rounds, i) for n, i in members] + order[len(members) :]
        if last:
            heap[: len(last)] = [(n + size, i) for n, i in last]
        heapq.heapify(heap)
    return turns


def turns_by_size(sizes: DataFrame, shards: int) -> DataFrame:
    """group_bytes, turns, for (group_bytes, groups)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        heap = [(0, i) for i in range(shards)]
        for batch in batches:
            turns = [deal(heap, *x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("shards", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"first": a, "shards": b} for a, b in x] for x in turns], kind)], names=["group_bytes", "turns"])

    ordered = sizes.select("group_bytes", "groups").repartition(1).sortWithinPartitions(F.desc("group_bytes"))
    return ordered.mapInArrow(run, f"group_bytes bigint, turns {_TURNS}")


def place_groups(groups: DataFrame, scratch: Scratch, shards: int = SHARDS) -> DataFrame:
    """text_md5, shard, for distinct (text_md5, group_bytes)."""
    sizes = groups.groupBy("group_bytes").agg(F.count("*").alias("groups"))
    turns = scratch.keep(turns_by_size(sizes, shards))
    # md5 is even over its range, so parts by its first 32 bits are even and keep its order
    parts = 1 + groups.count() // PART_GROUPS
    part = F.floor(F.conv(F.substring("text_md5", 1, 8), 16, 10).cast("bigint") * parts / 2.0**32)
    dealt = groups.withColumn("part", part)
    before = Window.partitionBy("group_bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("group_bytes", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(turns, "group_bytes").drop("n")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("group_bytes", "part").orderBy("text_md5")) - 1
    ranked = dealt.join(counts, ["group_bytes", "part"]).withColumn("rank", rank)
    turn = F.element_at(F.filter("turns", lambda t: t["first"] <= F.col("rank")), -1)
    ranked = ranked.withColumn("turn", turn)
    return ranked.select("text_md5", F.expr("element_at(turn.shards, CAST((rank - turn.first) % size(turn.shards) AS INT) + 1)").alias("shard"))


def number_rows(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of (doc_id, size, text_crc32, text_md5, copies, shard), each once for each copy, with `slot`."""
    chunk = F.explode(F.expr(f"sequence(0L, (copies - 1) DIV {COPIES})"))
    upto = F.least(F.lit(COPIES), F.col("copies") - F.col("chunk") * COPIES)
    placed = scratch.keep(placed.withColumn("chunk", chunk).withColumn("copies", upto))
    order = ["doc_id", "text_md5", "chunk"]
    ranged = scratch.keep(placed.repartitionByRange("shard", *order).withColumn("range", F.spark_partition_id()))
    # a row for each range, and one more for each shard
    counts = ranged.groupBy("shard", "range").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    numbered = ranged.join(counts, ["shard", "range"]).withColumn("first", first)
    return numbered.withColumn("slot", F.explode(F.expr("sequence(first, first + copies - 1)")))


def assign(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_bytes, text_md5: one row per document."""
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(said) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(said.cast("binary")).alias("text_crc32"), F.md5(said.cast("binary")).alias("text_md5"))
    rows = scratch.keep(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    groups = scratch.keep(rows.groupBy("text_md5").agg(F.sum(F.col("size") * F.col("copies")).alias("group_bytes")))
    placed = rows.join(place_groups(groups, scratch, shards).join(groups, "text_md5"), "text_md5")
    return number_rows(placed, scratch).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_bytes", "text_md5")
