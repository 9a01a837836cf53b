"""Operators over ordered series: differences, islands, rolling statistics, windows, padding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def trailing(key: list[str], order: list[str], rows: int) -> WindowSpec:
    return ordered(key, order).rowsBetween(-(rows - 1), 0)


def difference(value: Column, w: WindowSpec) -> Column:
    """value minus the one before; null in the first row."""
    return value - F.lag(value).over(w)


def islands(df: DataFrame, key: list[str], order: list[str], flag: str, position: str, **more: Column) -> DataFrame:
    """Maximal runs of rows where flag is true: key, island, first and last position, rows, and more aggregates of a run's rows."""
    w = ordered(key, order)
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    d = df.withColumn("_on", on).withColumn("_new", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    d = d.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    return d.groupBy(*key, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"), *[c.alias(name) for name, c in more.items()])


def pad(flag: Column, w: WindowSpec, before: int, after: int) -> Column:
    """1 within before rows ahead of a set row and after rows behind it."""
    return F.max(flag).over(w.rowsBetween(-after, before))


def rolling_median(value: Column, w: WindowSpec) -> Column:
    return F.percentile(value, 0.5).over(w)


def poincare(df: DataFrame, key: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """sd1, sd2, csi and mod_csi over the last rows values; null while there are fewer and where sd1 is 0."""
    w = ordered(key, order)
    d = df.withColumn("_b", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    d = d.withColumn("_minus", (F.col(value) - F.col("_b")) / F.sqrt(F.lit(2.0))).withColumn("_plus", (F.col(value) + F.col("_b")) / F.sqrt(F.lit(2.0)))
    frame = w.rowsBetween(-(rows - 2), 0)
    full = F.col("_n") >= rows
    d = d.withColumn("sd1", F.when(full, F.stddev_samp("_minus").over(frame))).withColumn("sd2", F.when(full, F.stddev_samp("_plus").over(frame)))
    some = F.col("sd1") > 1e-9
    d = d.withColumn("csi", F.when(some, F.col("sd2") / F.col("sd1"))).withColumn("mod_csi", F.when(some, F.pow(4 * F.col("sd2"), 2) / (4 * F.col("sd1"))))
    return d.drop("_b", "_n", "_minus", "_plus")


def central_difference_sum(df: DataFrame, key: list[str], order: list[str], value: str, rows: int, out: str = "hr_diff") -> DataFrame:
    """Rolling sum of next minus previous value; 0 at the series' ends, null while there are too few rows.

    The first row's difference is not counted.
    """
    w = ordered(key, order)
    d = df.withColumn("_d", F.coalesce(F.lead(value).over(w) - F.lag(value).over(w), F.lit(0.0))).withColumn("_n", F.row_number().over(w))
    return d.withColumn(out, F.when(F.col("_n") >= rows, F.sum("_d").over(w.rowsBetween(-(rows - 1), 0)))).drop("_d", "_n")


def relative_slope(df: DataFrame, key: list[str], order: list[str], value: str, rows: int, out: str = "slope") -> DataFrame:
    """|least-squares slope over the last rows values| / their mean; null while there are fewer."""
    w = ordered(key, order)
    d = df.withColumn("_n", F.row_number().over(w).cast("double"))
    frame = w.rowsBetween(-(rows - 1), 0)
    slope = F.abs(F.regr_slope(F.col(value), F.col("_n")).over(frame)) / F.avg(value).over(frame)
    return d.withColumn(out, F.when(F.col("_n") >= rows, slope)).drop("_n")


def fixed_windows(lengths: DataFrame, key: list[str], n: str, width: int, stride: int, least_tail: int | None = None, whole_if_short: bool = False) -> DataFrame:
    """Windows [start, end) of width rows every stride rows, from the number of rows of each series.

    A tail that no window covers gets a window of its own if it has at least least_tail rows; a series shorter than one
    window is one window if whole_if_short.
    """
    count = F.when(F.col(n) >= width, F.floor((F.col(n) - width) / stride).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct((i * stride).alias("start"), (i * stride + width).alias("end"), F.lit("full").alias("kind"))))
    d = lengths.withColumn("_w", F.coalesce(starts, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")))
    covered = F.when(count > 0, (count - 1) * stride + width).otherwise(F.lit(0).cast("long"))
    extra = F.struct(covered.alias("start"), F.col(n).cast("long").alias("end"), F.lit("trailing").alias("kind"))
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col(n).cast("long").alias("end"), F.lit("whole").alias("kind"))
    if least_tail is not None:
        d = d.withColumn("_w", F.when((count > 0) & (F.col(n) - covered >= least_tail), F.concat("_w", F.array(extra))).otherwise(F.col("_w")))
    if whole_if_short:
        d = d.withColumn("_w", F.when((F.col(n) < width) & (F.col(n) > 0), F.array(whole)).otherwise(F.col("_w")))
    return d.select(*key, F.posexplode("_w").alias("window_index", "_x")).select(*key, "window_index", "_x.start", "_x.end", "_x.kind")


def in_windows(df: DataFrame, key: list[str], position: str, width: int, stride: int) -> DataFrame:
    """Rows once for each full-width window [k * stride, k * stride + width) that they stand in, with window_index k."""
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(position) - width + 1) / stride).cast("long"))
    return df.withColumn("window_index", F.explode(F.sequence(low, F.floor(F.col(position) / stride).cast("long"))))


def clean_windows(df: DataFrame, key: list[str], position: str, exclude: Column, width: int, stride: int, batch: int) -> DataFrame:
    """key, window_index, start, batch: windows without an excluded row, and the mini-batch of so many windows that each is in."""
    n = F.count("*").over(Window.partitionBy(*key))
    w = in_windows(df.select(*key, position, exclude.cast("int").alias("_x"), n.alias("_n")), key, position, width, stride).where(F.col("window_index") * stride + width <= F.col("_n"))
    clean = w.groupBy(*key, "window_index").agg(F.max("_x").alias("_x")).where("_x = 0")
    order = F.row_number().over(ordered(key, ["window_index"])) - 1
    return clean.select(*key, "window_index", (F.col("window_index") * stride).alias("start"), F.floor(order / batch).cast("long").alias("batch"))


def reconstruct(df: DataFrame, key: list[str], position: str, value: str) -> DataFrame:
    """One series from overlapping windows: the mean of what they hold at each position."""
    return df.groupBy(*key, position).agg(F.avg(value).alias(value))


def resample(df: DataFrame, key: list[str], t: str, value: str, step: int) -> DataFrame:
    """Linear interpolation on a regular grid from each series' first to its last time.

    Each gap between neighbours makes the grid points that fall into it, so no row looks further than its neighbour.
    """
    w = ordered(key, [t])
    first = F.min(t).over(Window.partitionBy(*key))
    d = df.withColumn("_t0", first).withColumn("_t1", F.lead(t).over(w)).withColumn("_v1", F.lead(value).over(w))
    low = F.ceil((F.col(t) - F.col("_t0")) / step).cast("long")
    high = F.when(F.col("_t1").isNull(), F.floor((F.col(t) - F.col("_t0")) / step)).otherwise(F.ceil((F.col("_t1") - F.col("_t0")) / step) - 1).cast("long")
    d = d.where(high >= low).withColumn("k", F.explode(F.sequence(low, high)))
    at = F.col("_t0") + F.col("k") * step
    share = F.when(F.col("_t1").isNull() | (F.col("_t1") == F.col(t)), F.lit(0.0)).otherwise((at - F.col(t)) / (F.col("_t1") - F.col(t)))
    return d.select(*key, "k", (F.col(value) + share * (F.coalesce(F.col("_v1"), F.col(value)) - F.col(value))).alias(value))


def refractory(df: DataFrame, key: list[str], t: str, hold: int) -> DataFrame:
    """The alarms that are accepted when each accepted one suppresses the others for hold (closed at the end).

    The rule is sequential, so a series is walked in order; batches of a series follow each other and only the time of the
    last accepted alarm is carried, so a series of any length takes bounded memory.
    """
    columns = [*key, t]
    schema = df.select(*columns).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for b in batches:
            keep = []
            for row in b.itertuples(index=False):
                name, now = row[:-1], row[-1]
                if name != at:
                    at, last = name, None
                keep.append(last is None or now > last + hold)
                if keep[-1]:
                    last = now
            yield b[keep]

    dealt = df.select(*columns).repartition(*key).sortWithinPartitions(*key, t)
    return dealt.mapInPandas(run, schema)
