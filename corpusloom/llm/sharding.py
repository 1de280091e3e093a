"""Shards of contiguous groups with the smallest possible largest shard.

Rows with equal texts form an atomic group. Groups are ordered by the SHA-256 of their text and cut into
at most ``shards`` runs. The smallest feasible capacity is found by binary search; a capacity is feasible
if filling shards greedily takes no more than the allowed number. The running sums of the sizes never
reach the driver: it sees a bounded number of summed ranges of them, searches with lower and upper bounds,
and asks for finer ranges only where a cut can still fall, until the bounds agree. DataFrame functions only.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: So many summed ranges are on the driver at once.
RANGES = 20_000
#: The rows of one group are numbered in so many parts.
PARTS = 256
#: Leading hex digits of the hash that a running sum goes over in one task.
DIGITS = 3


class Ends:
    """Known ends of groups (running sums of sizes), gathered in ranges: of each range the first and last end in it."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.ranges = sorted(ranges)
        self.first = [a for a, _ in self.ranges]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds for the largest end that is x at most (0 before all)."""
        at = bisect.bisect_right(self.first, x) - 1
        if at < 0:
            return 0, 0
        a, b = self.ranges[at]
        return (b, b) if b <= x else (a, x)


def fill(ends: Ends, capacity: int, shards: int, upper: bool) -> list[int]:
    """Greedy cuts at a capacity; upper takes the most that a cut can be, else the least."""
    cuts, at = [], 0
    for _ in range(shards):
        at = ends.below(at + capacity)[upper]
        cuts.append(at)
    return cuts


def least_capacity(ends: Ends, low: int, high: int, total: int, shards: int, upper: bool) -> int:
    """The smallest capacity in [low, high] whose greedy cuts reach the total."""
    while low < high:
        mid = (low + high) // 2
        if fill(ends, mid, shards, upper)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def gathered(groups: DataFrame, spots: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    """First and last ends of each of so many ranges within the spots (lower and upper bounds, apart from each other)."""
    width = max(1, -(-sum(b - a + 1 for a, b in spots) // ranges))
    at: Column = F.lit(None).cast("struct<s:int,k:long>")
    for i, (a, b) in enumerate(spots):
        at = F.when(F.col("upto").between(a, b), F.struct(F.lit(i).alias("s"), F.floor((F.col("upto") - a) / F.lit(width)).alias("k"))).otherwise(at)
    rows = groups.select("upto", at.alias("r")).where("r IS NOT NULL").groupBy("r").agg(F.min("upto").alias("a"), F.max("upto").alias("b"))
    return [(r["a"], r["b"]) for r in rows.select("a", "b").collect()]


def minimax_cuts(groups: DataFrame, shards: int, ranges: int = RANGES) -> tuple[int, list[int]]:
    """The smallest capacity and the greedy cuts for it; groups has ``upto``, the running sum of sizes in order, and ``size``."""
    top = groups.agg(F.max("upto").alias("total"), F.max("size").alias("largest")).first()
    if top["total"] is None:
        return 0, [0] * shards
    total, largest = top["total"], top["largest"]
    low = max(largest, -(-total // shards))
    high = total // shards + largest
    spots = [(0, total)]
    known: list[tuple[int, int]] = []
    while True:
        fresh = gathered(groups, spots, ranges)
        # what was one range and is now looked at closer goes
        known = [(a, b) for a, b in known if not any(x <= a and b <= y for x, y in spots)] + fresh
        ends = Ends(known)
        high = min(high, least_capacity(ends, low, high, total, shards, upper=False))
        low = max(low, least_capacity(ends, low, high, total, shards, upper=True))
        if low == high and fill(ends, low, shards, False) == fill(ends, low, shards, True):
            return low, fill(ends, low, shards, False)
        spots = []
        lows, highs = [0, *fill(ends, low, shards, False)], [0, *fill(ends, high, shards, True)]
        for x, y in zip(lows[:-1], highs[:-1]):
            a, b = x + low, y + high
            i, j = bisect.bisect_right(ends.first, a) - 1, bisect.bisect_right(ends.first, b) - 1
            touched = [r for r in ends.ranges[max(0, i) : j + 1] if r[0] < r[1]]
            spots += touched
        spots = merged_spots(spots)


def merged_spots(spots: list[tuple[int, int]], most: int = 64) -> list[tuple[int, int]]:
    """The spots in order, each once; the closest are joined until there are ``most``."""
    out = sorted(set(spots))
    joined: list[tuple[int, int]] = []
    gaps = sorted((b[0] - a[1] for a, b in zip(out, out[1:])), reverse=True)
    least = gaps[most - 2] if len(gaps) > most - 2 else 0
    for a, b in out:
        if joined and (len(out) > most and a - joined[-1][1] <= least):
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and is in one group with empty
    texts. Rows of one group share a shard. slot numbers a shard's rows from 0, by group and, within a
    group, by id (null first) within 256 parts told by a hash of the id. grown_shard is null (law ``bytes``).
    Rows that share an id get slots of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("g"))
    rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")), "rows")
    parts = materialise(rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "parts")
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).withColumn("d", F.substring("g", 1, DIGITS))
    inner = Window.partitionBy("d").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    groups = materialise(groups.withColumns({"n_upto": F.sum("n").over(inner), "size_upto": F.sum("size").over(inner)}), "groups")
    # 16^DIGITS sums at most
    outer = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.groupBy("d").agg(F.sum("n").alias("dn"), F.sum("size").alias("ds")).select("d", F.coalesce(F.sum("dn").over(outer), F.lit(0)).alias("n_base"), F.coalesce(F.sum("ds").over(outer), F.lit(0)).alias("size_base"))
    placed = groups.join(F.broadcast(before), "d").select("g", "n", "size", (F.col("n_base") + F.col("n_upto")).alias("n_after"), (F.col("size_base") + F.col("size_upto")).alias("upto"))
    _, cuts = minimax_cuts(placed, shards)
    number: Column = F.lit(0)
    for k, cut in enumerate(cuts[:-1]):
        number = F.when(F.col("upto") > cut, F.lit(k + 1)).otherwise(number)
    placed = placed.withColumn("shard", number)
    first = placed.groupBy("shard").agg(F.min(F.col("n_after") - F.col("n")).alias("shard_first"))
    placed = placed.join(F.broadcast(first), "shard").select("g", "shard", (F.col("n_after") - F.col("n") - F.col("shard_first")).alias("group_slot"))
    by_part = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spots = parts.withColumn("part_slot", F.coalesce(F.sum("n").over(by_part), F.lit(0))).join(placed, "g").select("g", "part", "shard", (F.col("group_slot") + F.col("part_slot")).alias("base"))
    within = Window.partitionBy("g", "part").orderBy("id")
    return (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(spots, ["g", "part"])
        .select("id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
