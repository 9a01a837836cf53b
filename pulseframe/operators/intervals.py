"""Joins between points and intervals and between intervals; merging and deduplicating intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, key: list[str], t: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """Points inside closed intervals of the same key.

    Both sides get the number of the time bucket of the given width; an interval is repeated for each bucket it touches,
    so the join is an equi join on (key, bucket) and a key with very many rows is spread over its buckets.  A point
    stands in one bucket, so no match is found twice.
    """
    p = points.withColumn("_bucket", F.floor(F.col(t) / width).cast("long"))
    i = intervals.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(key)], *[c for c in intervals.columns if c not in key])
    i = i.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    same = [F.col(c) == F.col(f"_k{n}") for n, c in enumerate(key)]
    on = (F.col("_bucket") == F.col("_b")) & (F.col(t) >= F.col(low)) & (F.col(t) <= F.col(high))
    for c in same:
        on = on & c
    return p.join(i, on, how).drop("_bucket", "_b", *[f"_k{n}" for n in range(len(key))])


def first_match(points: DataFrame, intervals: DataFrame, key: list[str], t: str, point: str, interval: str, pre: int, post: int) -> DataFrame:
    """Each point with the first interval (by its number) whose extension [start - pre, end + post] holds it, else null."""
    wide = intervals.select(*key, interval, (F.col("start") - pre).alias("_low"), (F.col("end") + post).alias("_high"))
    width = 12 * 3600 * 1_000_000
    joined = range_join(points, wide, key, t, "_low", "_high", width, "left")
    return joined.groupBy(*key, point, t).agg(F.min(interval).alias(interval))


def overlaps(a: DataFrame, b: DataFrame, key: list[str], width: int, least: float | None = None) -> DataFrame:
    """Pairs of intervals (start, end) of the same key with a positive overlap, or one of at least a share of the shorter.

    The columns of b get the suffix _b; an interval without length has no share.  Both sides stand in each bucket of the given width that they touch, so the join is
    an equi join on (key, bucket) and a long series is spread over its buckets; a pair counts in the bucket where its
    overlap begins, so it is found once.
    """
    touched = F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")))
    r = b.withColumn("_at", touched).select(*[F.col(c).alias(f"{c}_b") for c in [*b.columns, "_at"]])
    begins = F.greatest("start", "start_b")
    on = (F.col("_at") == F.col("_at_b")) & (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")) & (F.col("_at") == F.floor(begins / width))
    for c in key:
        on = on & (F.col(c) == F.col(f"{c}_b"))
    j = a.withColumn("_at", touched).join(r, on).drop("_at", "_at_b")
    j = j.withColumn("overlap", (F.least("end", "end_b") - begins).cast("double") / F.nullif(F.least(F.col("end") - F.col("start"), F.col("end_b") - F.col("start_b")), F.lit(0)))
    return j if least is None else j.where(F.col("overlap") >= least)


def merge(intervals: DataFrame, key: list[str], gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap or stand at most gap apart."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    d = intervals.withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), 1).otherwise(0))
    d = d.withColumn("merged", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "merged").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def distinct_rounded(intervals: DataFrame, key: list[str], to: int) -> DataFrame:
    """One row for each pair of bounds rounded to multiples of ``to``: the earliest of the intervals behind it."""
    near = lambda c: F.floor((F.col(c) + to / 2) / to).cast("long")
    d = intervals.groupBy(*key, near("start").alias("_a"), near("end").alias("_b"))
    return d.agg(F.min("start").alias("start"), F.min("end").alias("end"), F.count("*").alias("n")).drop("_a", "_b")


def nearest(points: DataFrame, targets: DataFrame, key: list[str], t: str, target: str) -> DataFrame:
    """Each point with the nearest target time of its key (ties: the earlier), by one pass over both in order."""
    both = points.select(*key, t, F.lit(None).cast("long").alias("_target"), F.struct(*points.columns).alias("_row")).unionByName(
        targets.select(*key, F.col(target).alias(t), F.col(target).alias("_target"), F.lit(None).cast(points.select(F.struct(*points.columns).alias("s")).schema["s"].dataType).alias("_row"))
    )
    w = Window.partitionBy(*key).orderBy(t)
    back = F.last("_target", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_target", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    d = both.withColumn("_back", back).withColumn("_ahead", ahead).where("_row is not null")
    pick = F.when(F.col("_ahead").isNull() | (F.col(t) - F.col("_back") <= F.col("_ahead") - F.col(t)), F.col("_back")).otherwise(F.col("_ahead"))
    return d.select("_row.*", pick.alias("nearest"))
