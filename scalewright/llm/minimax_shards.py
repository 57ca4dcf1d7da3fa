"""Sharding by a minimax contiguous partition, in DataFrame operations only.

Rows with equal texts are one atomic group.  Groups are ordered by a 63-bit hash of their text, and the
order is cut into contiguous shards whose largest is as small as possible.  The smallest feasible
capacity is found by binary search with a greedy check.  The search needs the sizes of groups only near
the cuts, so sizes are summed over hash ranges first, and just the ranges in which a cut can fall are
summed again over finer ranges, until every such range is one group.  What reaches the driver is a few
thousand sums per level, whatever the input.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

KEY_BITS = 63
#: Each level splits a range of hashes into 2**LEVEL_BITS.
LEVEL_BITS = 9
#: Parts in which the rows of a shard are numbered, each by one task.
PARTS = 1024


class Range(NamedTuple):
    """Hashes ``prefix`` << ``shift`` and following: summed size; ``last``: largest hash; whether it is one group."""

    prefix: int
    shift: int
    size: int
    last: int
    single: bool


def _sums(rows: DataFrame, level: int, parents: list[int]) -> list[Range]:
    shift = max(0, KEY_BITS - LEVEL_BITS * level)
    prefix = F.shiftrightunsigned("key", shift)
    if parents:
        rows = rows.where(F.shiftrightunsigned("key", KEY_BITS - LEVEL_BITS * (level - 1)).isin(parents))
    found = rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last")).collect()
    return [Range(r["prefix"], shift, r["size"], r["last"], r["first"] == r["last"]) for r in found]


def greedy_ends(sizes: list[int], capacity: int) -> list[int]:
    """Indices after which a shard is full when each takes as much as ``capacity`` allows."""
    ends, held = [], 0
    for i, size in enumerate(sizes):
        if held + size > capacity and i:
            ends.append(i - 1)
            held = 0
        held += size
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the least capacity with which the greedy check needs at most ``shards``."""
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(greedy_ends(sizes, middle)) < shards else (middle + 1, high)
    return low


def cut_keys(rows: DataFrame, shards: int) -> list[int]:
    """Largest keys of all shards but the last, for a table (key, size)."""
    ranges = sorted(_sums(rows, 1, []), key=lambda r: r.prefix << r.shift)
    if not ranges:
        return []
    for level in range(2, -(-KEY_BITS // LEVEL_BITS) + 1):
        sizes = [r.size for r in ranges]
        high = smallest_capacity(sizes, shards)
        low = max([-(-sum(sizes) // shards), *(r.size for r in ranges if r.single)], default=0)
        # A cut after shard s lies between what s greedy shards of the least capacity hold and s of the largest.
        sums = list(accumulate(sizes))
        least = [sums[i] for i in greedy_ends(sizes, low)]
        spans = [(least[s] if s < len(least) else sums[-1], (s + 1) * high) for s in range(shards - 1)]
        open_ = [r for r, end in zip(ranges, sums) if not r.single and any(lo <= end and end - r.size <= hi for lo, hi in spans)]
        if not open_:
            break
        finer = _sums(rows, level, [r.prefix for r in open_])
        ranges = sorted([r for r in ranges if r not in set(open_)] + finer, key=lambda r: r.prefix << r.shift)
    sizes = [r.size for r in ranges]
    return [ranges[i].last for i in greedy_ends(sizes, smallest_capacity(sizes, shards))]


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the largest shard is as small as contiguous cuts allow.  Size is the UTF-8 length of
    the text plus 1; null counts as empty, and null and empty texts are one group.  A group larger than
    an equal share fills a shard alone.  With fewer groups than shards the last shards stay empty.  An
    empty table gives no rows.  Slots follow a hash and the id; repeated rows get a slot each.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = saved(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(value), 1).alias("key")),
        "shard-rows",
    )
    cuts = cut_keys(rows, shards)
    shard: Column = reduce(lambda n, cut: n + (F.col("key") > cut).cast("int"), cuts, F.lit(0))
    placed = saved(rows.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(PARTS)).cast("int")), "shard-placed")
    # Rows are numbered within (shard, part); at most shards x PARTS counts give each part its first slot.
    counts = placed.groupBy("shard", "part").count()
    first = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(first), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
