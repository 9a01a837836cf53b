"""Grouping alarms by time and choosing representatives; sweeps over strategies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_gap(df: DataFrame, key: list[str], t: str, theta: Column | int, tie: str) -> DataFrame:
    """Adds cluster: a new one begins where the time since the row before is over theta."""
    w = Window.partitionBy(*key).orderBy(t, tie)
    new = F.when(F.col(t) - F.lag(t).over(w) > theta, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def representatives(df: DataFrame, key: list[str], t: str, tie: str, distinct_times: bool = True) -> DataFrame:
    """One row a cluster: the member with the smallest mean distance to the others, the first on ties.

    The distances' sums follow from running sums in time order, so a cluster of any size is one sort.  With
    distinct_times members at the same time do not count as others; else the sum is divided by the others' number.
    """
    c = [*key, "cluster"]
    w = Window.partitionBy(*c)
    up = w.orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_n", F.count("*").over(w)).withColumn("_all", F.sum(t).over(w)).withColumn("_k", F.count("*").over(up)).withColumn("_s", F.sum(t).over(up))
    d = d.withColumn("_same", F.count("*").over(Window.partitionBy(*c, t)))
    total = F.col(t) * F.col("_k") - F.col("_s") + (F.col("_all") - F.col("_s")) - F.col(t) * (F.col("_n") - F.col("_k"))
    others = (F.col("_n") - F.col("_same")) if distinct_times else (F.col("_n") - 1)
    d = d.withColumn("_mean", F.when(others > 0, total.cast("double") / others).otherwise(0.0))
    kept = [x for x in df.columns if x not in c]
    best = d.groupBy(*c).agg(F.min(F.struct("_mean", t, tie, *[F.col(x).alias(f"_x{i}") for i, x in enumerate(kept)])).alias("_r"), F.count("*").alias("size"), (F.max(t) - F.min(t)).alias("span"))
    return best.select(*c, *[F.col(f"_r._x{i}").alias(x) for i, x in enumerate(kept)], "size", "span")


def _medoids(t: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of times that ascend in each group, where new marks a group's first: the group's member with the smallest mean distance to others
    at other times (the first on ties), the group's size and span."""
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(t)))
    first, n = np.repeat(start, size), np.repeat(size, size)
    k = np.arange(len(t)) - first + 1
    own = t - t[first]
    sums = np.concatenate(([0], np.cumsum(own)))
    upto, every = sums[1:] - sums[first], sums[first + n] - sums[first]
    total = own * k - upto + (every - upto) - own * (n - k)
    same = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (first[1:] != first[:-1]))))
    alike = np.diff(np.append(same, len(t)))
    others = n - np.repeat(alike, alike)
    mean = np.where(others > 0, total / np.maximum(others, 1), 0.0)
    least = np.repeat(np.minimum.reduceat(mean, start), size)
    hit = np.flatnonzero(mean == least)
    group = np.repeat(np.arange(len(start)), size)[hit]
    best = hit[np.concatenate(([True], group[1:] != group[:-1]))]
    return best, size, t[start + size - 1] - t[start]


Picked = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _swept(df: DataFrame, key: list[str], t: str, tie: str, thetas: str, more: list[str], schema: str, body: Callable[[pd.DataFrame, np.ndarray, list[Picked]], pd.DataFrame], value: str | None = None, least: list[float] | None = None) -> DataFrame:
    """body(rows, number of each row's series, (setting, representatives, sizes, spans) of each setting) for complete series, many at a time."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        times, ids = rows[t].to_numpy(np.int64), rows[key].to_numpy()
        fresh = np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1)))
        series = np.cumsum(fresh) - 1
        gaps = np.stack(rows[thetas].to_numpy()[fresh])  # a row a series
        picked: list[Picked] = []
        if least is None:
            after = np.diff(times)
            for k in range(gaps.shape[1]):
                best, size, span = _medoids(times, np.concatenate(([True], fresh[1:] | (after > gaps[series[1:], k]))))
                picked.append((k, best, size, span))
        else:
            scores = rows[value].to_numpy()
            for k, x in enumerate(least):
                part = np.flatnonzero(scores >= x)
                if len(part):
                    at = series[part]
                    best, size, span = _medoids(times[part], np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(times[part]) > gaps[at[1:], 0]))))
                    picked.append((k, part[best], size, span))
        return body(rows, series, picked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            last = b[key].iloc[-1]
            if (held[0][key].iloc[0] == last).all():
                continue  # one series so far
            every = pd.concat(held, ignore_index=True)
            open_ = int((every[key] == last).all(axis=1).to_numpy().argmax())
            yield whole(every[:open_])
            held = [every[open_:]]
        if held:
            yield whole(pd.concat(held, ignore_index=True))

    dealt = df.select(*key, tie, t, thetas, *more).repartition(*key).sortWithinPartitions(*key, t, tie)
    return dealt.mapInPandas(run, schema)


def sweep(df: DataFrame, key: list[str], t: str, tie: str, thetas: str, value: str | None = None, least: list[float] | None = None) -> DataFrame:
    """Representatives for many settings from one sort of each series: setting, key, tie, t, size, span.

    thetas is a column with an array of gaps, the same in all rows of a series; setting is the place of a gap in it.  With
    ``least`` there is one gap, and setting is the place of a least value: only rows that reach it take part.  A task
    holds a batch of series at a time, or one; only representatives leave it.
    """
    names = [*key, tie, t]
    schema = ", ".join(["setting int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema), "size long", "span long"])

    def body(rows: pd.DataFrame, _: np.ndarray, picked: list[Picked]) -> pd.DataFrame:
        if not picked:
            return pd.DataFrame(columns=["setting", *names, "size", "span"])
        setting = np.repeat(np.array([p[0] for p in picked], np.int32), [len(p[1]) for p in picked])
        at, size, span = (np.concatenate([p[i] for p in picked]) for i in (1, 2, 3))
        return rows[names].iloc[at].assign(setting=setting, size=size, span=span)[["setting", *names, "size", "span"]]

    return _swept(df, key, t, tie, thetas, [value] if value else [], schema, body, value, least)


def sweep_hits(df: DataFrame, key: list[str], t: str, tie: str, thetas: str, hit: str) -> DataFrame:
    """setting, key, clusters, tp: how many ties of a series represent a cluster for each gap of thetas (see sweep), and how many of these
    with a true hit; a row a series and setting leaves the task instead of all representatives."""
    schema = ", ".join(["setting int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema), "clusters long", "tp long"])

    def body(rows: pd.DataFrame, series: np.ndarray, picked: list[Picked]) -> pd.DataFrame:
        code, hits = pd.factorize(rows[tie], use_na_sentinel=False)[0], rows[hit].to_numpy(bool)
        names = rows[key][np.concatenate(([True], series[1:] != series[:-1]))].reset_index(drop=True)
        out = []
        for k, best, _, _ in picked:
            every, true = (np.unique(series[some] * len(rows) + code[some]) for some in (best, best[hits[best]]))  # a tie counts once
            count = lambda x: np.bincount(x // len(rows), minlength=len(names))
            out.append(names.assign(setting=np.int32(k), clusters=count(every), tp=count(true)))
        return pd.concat(out)[["setting", *key, "clusters", "tp"]]

    return _swept(df, key, t, tie, thetas, [hit], schema, body)


def gap_means(df: DataFrame, key: list[str], position: str, gap: int, least: int) -> DataFrame:
    """Mean positions (rounded half to even) of groups of at least ``least`` positions that stand at most gap apart."""
    d = by_gap(df, key, position, gap, position)
    g = d.groupBy(*key, "cluster").agg(F.count("*").alias("n"), F.bround(F.avg(position), 0).cast("long").alias("position"))
    return g.where(F.col("n") >= least)


def adaptive_theta(df: DataFrame, key: list[str], t: str, tie: str, base: int) -> DataFrame:
    """key, theta: base times the median gap over base, clipped to 0.5 to 2 (the upper median; base without gaps)."""
    w = Window.partitionBy(*key).orderBy(t, tie)
    g = df.withColumn("_gap", F.col(t) - F.lag(t).over(w)).where("_gap is not null")
    ranked = g.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_gap"))).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    median = ranked.where("_r = floor(_n / 2) + 1").select(*key, F.col("_gap"))
    ratio = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("_gap") / float(base)))
    return df.select(*key).distinct().join(median, key, "left").select(*key, F.coalesce((ratio * base).cast("long"), F.lit(base)).alias("theta"))


def percentile_theta(df: DataFrame, key: list[str], t: str, tie: str, p: float, least: int) -> DataFrame:
    """key, theta: the gap at index int(p * (n - 1)) of the ascending gaps, at least ``least``; least without gaps."""
    w = Window.partitionBy(*key).orderBy(t, tie)
    g = df.withColumn("_gap", F.col(t) - F.lag(t).over(w)).where("_gap is not null")
    ranked = g.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_gap"))).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    picked = ranked.where(F.col("_r") == F.floor(F.lit(p) * (F.col("_n") - 1)) + 1).select(*key, "_gap")
    return df.select(*key).distinct().join(picked, key, "left").select(*key, F.greatest(F.coalesce("_gap", F.lit(least)), F.lit(least)).alias("theta"))


def score_aware(df: DataFrame, key: list[str], t: str, score: str, tie: str, theta: int) -> DataFrame:
    """Clusters grown in the order of falling scores: a row joins the current cluster if any member is within theta,
    else it begins a new one; equal scores in the order of time.  Sequential in a series; members are kept as sorted times.
    """
    return score_aware_sweep(df, key, t, score, tie, [theta]).withColumn("cluster", F.element_at("clusters", 1)).drop("clusters")


def score_aware_sweep(df: DataFrame, key: list[str], t: str, score: str, tie: str, thetas: list[int], more: Sequence[str] = ()) -> DataFrame:
    """key, more columns, tie, t, score and clusters: the number of a row's score-aware cluster for each theta, from one pass over each series."""
    columns = [*key, *more, tie, t, score]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema), "clusters array<long>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_left, insort

        at, number, members = None, [], []
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                name, now = row[: len(key)], row[-2]
                if name != at:
                    at, number, members = name, [-1] * len(thetas), [[] for _ in thetas]
                for i, theta in enumerate(thetas):
                    own = members[i]
                    k = bisect_left(own, now)
                    if not ((k < len(own) and own[k] - now <= theta) or (k > 0 and now - own[k - 1] <= theta)):
                        number[i], own = number[i] + 1, []
                        members[i] = own
                    insort(own, now)
                out.append(list(number))
            yield b.assign(clusters=pd.Series(out, index=b.index, dtype=object))

    dealt = df.select(*columns).repartition(*key).sortWithinPartitions(*key, F.desc(score), t, tie)
    return dealt.mapInPandas(run, schema)


def strategy_score(fp_before: Column, fp_after: Column, n_before: Column, n_after: Column, sens_before: Column, sens_after: Column) -> Column:
    """0.6 * reduction of false alarms + 0.3 * reduction of alarms - 2 * loss of sensitivity."""
    less = lambda a, b: F.when(a > 0, (a - b).cast("double") / a).otherwise(0.0)
    return 0.6 * less(fp_before, fp_after) + 0.3 * less(n_before, n_after) - 2.0 * F.greatest(F.lit(0.0), sens_before - sens_after)
