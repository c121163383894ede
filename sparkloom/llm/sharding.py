"""Sharding (7): minimax contiguous partition of ordered atomic groups.

Rows of equal texts form a group, which stays whole; groups are ordered by their smallest id. The smallest capacity at which
the groups, in order, fit into the shards is found by binary search, each capacity being checked greedily. The cuts then keep
that capacity and, within it, come as near to equal shares of what is left as whole groups allow.

The greedy check needs only "the last group boundary at or below x". The driver holds at most `blocks` boundaries: all of
them while there are no more groups than that, else one for each block of consecutive groups, and then the few blocks in
which cuts fall are read on demand. So the answer is exact at every size and the driver's share is bounded.

Defined cases: null texts form a group of their own, of size 16 each; empty texts likewise; a null id comes first; a group
larger than an equal share has a shard to itself as far as possible; with fewer groups than shards some shards are empty; an
empty table gives an empty result; repeated rows get a slot each; other columns aren't read.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plan import join_skewed, running, stored

OVERHEAD = 16


class Boundaries:
    """Sorted group boundaries (running sizes), of which only the ends of blocks are held; blocks are read when asked for."""

    def __init__(self, block_ends: np.ndarray, fetch=None):
        self.ends, self.fetch, self.cache = block_ends, fetch, {}

    def _fine(self, b: int) -> np.ndarray:
        if self.fetch is None:
            return self.ends[b : b + 1]
        if b not in self.cache:
            self.cache[b] = self.fetch(b)
        return self.cache[b]

    def at_most(self, x: int) -> int:
        """The largest boundary up to x, 0 counting as one."""
        b = int(np.searchsorted(self.ends, x, "right"))
        below = int(self.ends[b - 1]) if b else 0
        if b == len(self.ends) or self.fetch is None:
            return below
        fine = self._fine(b)
        k = int(np.searchsorted(fine, x, "right"))
        return int(fine[k - 1]) if k else below

    def at_least(self, x: int) -> int:
        """The smallest boundary from x on."""
        if x <= 0:
            return 0
        b = min(int(np.searchsorted(self.ends, x, "left")), len(self.ends) - 1)
        fine = self._fine(b)
        return int(fine[min(int(np.searchsorted(fine, x, "left")), len(fine) - 1)])


def minimax(bounds: Boundaries, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and shards - 1 cuts that keep it."""

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bounds.at_most(at + capacity)
            if at >= total:
                return True
        return False

    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    capacity = low
    # the earliest place of each cut from which the rest still fits
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(bounds.at_least(earliest[-1] - capacity))
    earliest = earliest[::-1]
    cuts, at = [], 0
    for k in range(shards - 1):
        share = at + (total - at) // (shards - k)
        below = bounds.at_most(share)
        above = bounds.at_least(share)
        near = below if share - below <= above - share else above
        at = max(at, min(max(near, earliest[k]), bounds.at_most(at + capacity)))
        cuts.append(at)
    return capacity, cuts


def text_key(text: Column) -> Column:
    """Equal for equal texts; a null is equal to nulls only."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b"null"))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each key: its smallest id, size and count."""
    return rows.groupBy("_key").agg(F.min("_id").alias("_first"), F.sum("_size").alias("_group_size"), F.count("*").alias("_count"))


def cut(rows: DataFrame, shards: int, blocks: int = 1 << 20) -> tuple[DataFrame, list[int], int]:
    """For rows of (_id, _key, _size): the groups with the size before each (_before), the cuts, and the number of rows."""
    groups, totals = running(groups_of(rows), [F.col("_first").asc_nulls_first(), F.col("_key")], {"_before": F.col("_group_size"), "_rank": F.lit(1), "_rows": F.col("_count")}, "groups")
    groups = stored(groups, "ranked")
    total, n = totals["_before"], totals["_rank"]
    if not n:
        return groups, [0] * (shards - 1), 0
    per = max(1, -(-n // blocks))
    ends = groups.groupBy(F.floor(F.col("_rank") / per).alias("b")).agg(F.max(F.col("_before") + F.col("_group_size")).alias("end"), F.max("_group_size").alias("most"))
    found = ends.orderBy("b").toPandas()  # at most `blocks` rows

    def fetch(b: int) -> np.ndarray:
        part = groups.where((F.col("_rank") >= b * per) & (F.col("_rank") < (b + 1) * per))
        return np.sort(part.select((F.col("_before") + F.col("_group_size")).alias("end")).toPandas()["end"].to_numpy(np.int64))

    bounds = Boundaries(found["end"].to_numpy(np.int64), fetch if per > 1 else None)
    return groups, minimax(bounds, total, int(found["most"].max()), shards)[1], totals["_rows"]


def shard_of(before: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below a group's place."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= before)).cast("int") if cuts else F.lit(0)


def assign(docs: DataFrame, shards: int = 40, on: str = "doc_id", text: str = "text", blocks: int = 1 << 20) -> DataFrame:
    """For each row its id, size, CRC-32 of the text, shard, and slot within the shard (by group, then id)."""
    t = F.col(text)
    rows = docs.select(F.col(on).alias("_id"), text_key(t).alias("_key"), (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("_size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("_crc"))
    rows = stored(rows, "rows")
    groups, cuts, n = cut(rows, shards, blocks)
    placed = join_skewed(rows, groups.select("_key", "_before", "_count"), "_key", "_count", n)
    ordered, _ = running(placed.select("_id", "_size", "_crc", "_before"), [F.col("_before"), F.col("_id").asc_nulls_first()], {"_row": F.lit(1)}, "slots")
    ordered = stored(ordered.withColumn("shard", shard_of(F.col("_before"), cuts)), "placed")
    firsts = ordered.groupBy("shard").agg(F.min("_row").alias("_base"))  # a row for each shard
    return ordered.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(on), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("_row") - F.col("_base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def place(docs: DataFrame, shards: int = 40, on: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns kept, with their shard appended as `shard` (or a free name)."""
    from .quality_rules import free_name

    t, key, name = F.col(text), free_name(docs, "_key"), free_name(docs, "shard")
    rows = stored(docs.select(F.col(on).alias("_id"), text_key(t).alias("_key"), (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("_size")), "rows")
    groups, cuts, n = cut(rows, shards)
    at = stored(groups.select(F.col("_key").alias(key), F.col("_count").alias(key + "_n"), shard_of(F.col("_before"), cuts).alias(name)), "shards")
    return join_skewed(docs.withColumn(key, text_key(t)), at, key, key + "_n", n).select(*docs.columns, name)


def brute_force(sizes: list[int], shards: int) -> int:
    """The smallest capacity, by trying every one, for tests."""
    ends = list(np.cumsum(sizes))
    capacity = max(sizes)
    while True:
        at = 0
        for _ in range(shards):
            k = bisect.bisect_right(ends, at + capacity)
            at = ends[k - 1] if k else 0
        if at == ends[-1]:
            return capacity
        capacity += 1
