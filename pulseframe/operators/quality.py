"""Signal quality and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import islands, ordered


def saturation_segments(df: DataFrame, key: list[str], position: str, value: str, rows: int, low: Column, high: Column) -> DataFrame:
    """Segments of rows positions; bad with under 10 distinct values, a range under 0.001, or over 5 % at the limits."""
    d = df.withColumn("segment", F.floor(F.col(position) / rows).cast("long"))
    g = d.groupBy(*key, "segment").agg(
        F.count("*").alias("n"), F.countDistinct(value).alias("n_distinct"), (F.max(value) - F.min(value)).alias("spread"), F.avg(((F.col(value) <= low) | (F.col(value) >= high)).cast("double")).alias("at_limit")
    )
    return g.withColumn("bad", (F.col("n_distinct") < 10) | (F.col("spread") < 0.001) | (F.col("at_limit") > 0.05))


def saturation(segments: DataFrame, key: list[str]) -> DataFrame:
    """Segments, bad segments and their percentage; a segment is bad if it is in any channel (all share the key)."""
    s = segments.groupBy(*key, "segment").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    return s.groupBy(*key).agg(F.count("*").alias("segments"), F.sum("bad").alias("bad_segments")).withColumn("percent", 100.0 * F.col("bad_segments") / F.col("segments"))


def exclusion_curve(runs: DataFrame, percent: str, thresholds: list[float]) -> DataFrame:
    """How many runs have at least each percentage."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    d = runs.select(percent, at)
    return d.groupBy("threshold").agg(F.count("*").alias("runs"), F.sum((F.col(percent) >= F.col("threshold")).cast("int")).alias("excluded")).withColumn("share", F.col("excluded") / F.col("runs"))


def constant_regions(df: DataFrame, key: list[str], position: str, value: str, eps: float, least: int) -> DataFrame:
    """Runs of at least ``least`` values that differ from their neighbour by under eps: first, last, n."""
    w = ordered(key, [position])
    near = lambda other: F.coalesce(F.abs(F.col(value) - other) < eps, F.lit(False))
    d = df.withColumn("_back", near(F.lag(value).over(w)))
    i = islands(d, key, [position], "_back", position)
    return i.where(F.col("n") + 1 >= least).select(*key, (F.col("first") - 1).alias("first"), "last", (F.col("n") + 1).alias("n"))


def has_constant(df: DataFrame, key: list[str], position: str, value: str, eps: float, least: int, variance: float) -> DataFrame:
    """A row a series: whether it has a constant region, or a constant pair and a variance under the limit."""
    w = ordered(key, [position])
    d = df.withColumn("_pair", (F.abs(F.col(value) - F.lag(value).over(w)) < eps).cast("int"))
    s = d.groupBy(*key).agg(F.var_pop(value).alias("variance"), F.coalesce(F.max("_pair"), F.lit(0)).alias("pair"))
    r = constant_regions(df, key, position, value, eps, least).groupBy(*key).agg(F.count("*").alias("regions"))
    j = s.join(r, key, "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
    return j.withColumn("constant", (F.col("regions") > 0) | ((F.col("pair") == 1) & (F.col("variance") < variance)))


def without_regions(df: DataFrame, regions: DataFrame, key: list[str], position: str) -> DataFrame:
    """The rows outside all regions, with new_position counted from 0 and old_position."""
    w = ordered(key, [position])
    edge = regions.select(*key, F.explode(F.array(F.struct(F.col("first").alias("p"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("p"), F.lit(-1).alias("d")))).alias("e"))
    edge = edge.groupBy(*key, F.col("e.p").alias(position)).agg(F.sum("e.d").alias("_d"))
    d = df.join(edge, [*key, position], "left").withColumn("_in", F.sum(F.coalesce("_d", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("_in = 0").withColumn("new_position", F.row_number().over(w).cast("long") - 1).drop("_in", "_d")


def channel_quality(df: DataFrame, key: list[str], position: str, value: str, rows: int, high: float) -> DataFrame:
    """Of the first rows values: shares that are zero, saturated, usable; good, partial or empty."""
    d = df.where(F.col(position) < rows).groupBy(*key).agg(
        F.count("*").alias("n"), F.avg((F.col(value) == 0).cast("double")).alias("zero"), F.avg((F.col(value) >= high).cast("double")).alias("saturated")
    )
    d = d.withColumn("usable", 1 - F.col("zero") - F.col("saturated"))
    return d.withColumn("quality", F.when(F.col("usable") >= 0.9, "good").when(F.col("usable") > 0.1, "partial").otherwise("empty"))


def completeness(raw: DataFrame, processed: DataFrame, key: list[str], expected: str, found: str) -> DataFrame:
    """Keys of both sides: missing, extra, unlabelled (expects events but has none) or complete."""
    a, b = raw.select(*key, expected, F.lit(True).alias("_a")), processed.select(*key, found, F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when((F.col(expected) > 0) & (F.coalesce(found, F.lit(0)) == 0), "unlabelled").otherwise("complete")
    return j.select(*key, F.coalesce(expected, F.lit(0)).alias(expected), F.coalesce(found, F.lit(0)).alias(found), status.alias("status"))
