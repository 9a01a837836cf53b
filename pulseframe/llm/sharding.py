"""Sharding by minimax contiguous partition (operator 8).

Documents with equal texts form an atomic group; groups stand in the order of their smallest doc_id.  The smallest
capacity for which a greedy pass fills at most the given number of shards is found by binary search.  Where a large group
sets that capacity, a second search finds the least bound of the same pass for the shards without such a group, so that
the rest is spread evenly; the shards are cut where this pass cuts.

The running sizes of the groups stay distributed.  The driver holds a bounded picture of them, the exact running size at
the end of each of some value ranges; with it the greedy pass is done twice for a capacity, with the least and the most
that each shard can hold.  Where the two disagree, the ranges that the open capacities touch are split, and so on
until the pass is exact.

Defined cases: a null text counts as empty and equals it; its size is 1; a null doc_id sorts before the others; repeated
rows belong to one group and have slots of their own; an empty table gives an empty result; where there are fewer groups
than shards the last shards stay empty.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_of, prefix_sums, text_of

SHARDS = 16
#: Value ranges in the driver's picture for each shard and round.
RESOLUTION = 2048


class _Picture:
    """Known running sizes, ascending; exact[i] says that no other lies between it and the one before."""

    def __init__(self) -> None:
        self.known: dict[int, bool] = {0: True}

    def add(self, rows) -> None:
        """rows: (smallest, largest, count) running size in a range; what lies strictly between is unknown."""
        for low, high, n in rows:
            self.known[low] = True
            self.known[high] = self.known.get(high, False) and high != low or n <= 2 or high == low
        self.sums = sorted(self.known)

    def reach(self, x: int, most: bool) -> tuple[int, bool]:
        """The largest running size up to x, or a bound of it, and whether it is exact."""
        i = bisect_right(self.sums, x) - 1
        if self.sums[i] == x or i + 1 == len(self.sums) or self.known[self.sums[i + 1]]:
            return self.sums[i], True
        return (x if most else self.sums[i]), False


def _walk(p: _Picture, capacity: int, shards: int, total: int, most: bool) -> tuple[list[int], bool]:
    at, cuts, sure = 0, [], True
    for _ in range(shards):
        at, exact = p.reach(at + capacity, most)
        sure &= exact
        cuts.append(at)
        if at >= total:
            break
    return cuts, sure


def minimax_cuts(groups: DataFrame, shards: int, resolution: int = RESOLUTION) -> tuple[int, list[int]]:
    """groups has the running size ``upto`` of each group, in order; the capacity and the running sizes at the cuts."""
    total, largest = groups.agg(F.max("upto"), F.max("size")).first()
    if not total:
        return 0, []
    p = _Picture()
    windows = [(0, total)]
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # greedy always fits the upper one
    while True:
        spans = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(i).alias("i")) for i, (a, b) in enumerate(windows)])
        inside = groups.select("upto", F.explode(F.filter(spans, lambda w: (F.col("upto") > w["a"]) & (F.col("upto") <= w["b"]))).alias("w"))
        step = F.greatest(F.lit(1).cast("long"), ((F.col("w.b") - F.col("w.a")) / resolution).cast("long") + 1)
        ranges = inside.groupBy("w.i", ((F.col("upto") - F.col("w.a") - 1) / step).cast("long").alias("k")).agg(F.min("upto").alias("low"), F.max("upto").alias("high"), F.count("*").alias("n"))
        p.add((r.low, r.high, r.n) for r in ranges.collect())  # at most resolution + 1 rows a window
        a, b = low, high
        while a < b:  # the least capacity that may fit
            mid = (a + b) // 2
            if _walk(p, mid, shards, total, True)[0][-1] >= total:
                b = mid
            else:
                a = mid + 1
        low, b = a, high
        a = low
        while a < b:  # the least capacity that surely fits
            mid = (a + b) // 2
            if _walk(p, mid, shards, total, False)[0][-1] >= total:
                b = mid
            else:
                a = mid + 1
        high = a
        cuts, sure = _walk(p, high, shards, total, False)
        if low == high and sure:
            return high, level_cuts(p, high, shards, total)
        least, most = _walk(p, low, shards, total, False)[0], _walk(p, high, shards, total, True)[0]
        open_at, a, b = [], 0, 0
        for k in range(shards):  # where a pass with an open capacity may look for its next cut
            a, b = (least[k - 1] if k and k <= len(least) else a) + low, (most[k - 1] if k and k <= len(most) else b if k else 0) + high
            x, y = p.sums[max(0, bisect_right(p.sums, a) - 1)], next((s for s in p.sums[bisect_right(p.sums, min(b, total) - 1) :]), total)
            if x < y:
                open_at.append((x, y))
        windows = []
        for x, y in sorted(open_at):
            if windows and x <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(y, windows[-1][1]))
            else:
                windows.append((x, y))
        resolution *= 2  # at the latest, ranges of one value each are exact


def level_cuts(p: _Picture, capacity: int, shards: int, total: int) -> list[int]:
    """Cuts at known running sizes, no shard over the capacity, with the least bound on the shards that hold several groups.

    The capacity is that of the largest group where one is larger than its share.  The same greedy pass then levels the
    rest: it takes a bound below the capacity, and a group over that bound gets a shard of its own.
    """

    def walk(bound: int) -> list[int]:
        at, cuts = 0, []
        while at < total and len(cuts) <= shards:
            i = bisect_right(p.sums, at + bound) - 1
            at = p.sums[i] if p.sums[i] > at else p.sums[i + 1]
            cuts.append(at)
        return cuts

    low, high = 1, capacity
    while low < high:
        mid = (low + high) // 2
        cuts = walk(mid)
        if len(cuts) <= shards and all(b - a <= capacity for a, b in zip([0, *cuts], cuts, strict=False)):
            high = mid
        else:
            low = mid + 1
    return walk(high)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and capacity for every document."""
    text = text_of()
    rows = docs.select(
        "doc_id",
        id_of().alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("_text"),
    )
    rows = cut(rows)
    groups = rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.sum("size").alias("size"), F.count("*").alias("_rows"))
    groups = cut(prefix_sums(groups, ["_first", "_text"], {"upto": "size", "_rows_upto": "_rows"}))
    capacity, cuts = minimax_cuts(groups, shards)
    ends = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    placed = groups.select("_text", "_first", (F.size(F.filter(ends, lambda c: c < F.col("upto")))).cast("int").alias("shard"), "_rows")
    starts = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("_rows").alias("n")).collect()}  # one row a shard
    first = F.array(*[F.lit(sum(n for k, n in starts.items() if k < s)).cast("long") for s in range(shards)])
    rows = rows.join(placed.select("_text", "_first", "shard"), "_text").withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_sums(rows, ["_first", "_text", "_id"], {"_rank": "_one"})
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - 1 - F.element_at(first, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )
