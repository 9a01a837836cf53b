"""Similarity search in series: distance profiles, matrix profiles, discords.

Series are rows (key, pos, v), or short ones a row each (key, ``values`` array<double>).  The searches work on segments of a series and
pairs of these (see segments); what is done for a whole series in one place works on short ones or on few of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import segments

FLOOR = 1e-10
#: Windows of a segment, whose pairs are the tasks' work.
TILE = 8192


def distance_profile(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """z-normalised distances of the query to all windows of x, by one Fourier product; a constant query is infinitely far.

    Query and series are centred first, so the offset of the series does not matter.
    """
    m = len(query)
    if query.std() < FLOOR:
        return np.full(len(x) - m + 1, np.inf)
    w, q = segments.Windows(x, m), query - query.mean()
    size = 1 << int(np.ceil(np.log2(len(x) + m)))
    dot = np.fft.irfft(np.fft.rfft(w.x, size) * np.fft.rfft(q[::-1], size), size)[m - 1 : len(x)]
    norm = np.sqrt((q * q).sum())
    for i in np.flatnonzero(dot * w.inverse > 0.99 * norm).tolist():  # near windows directly: a small distance shows the product's rounding
        dot[i] = w.centred(i) @ q
    return segments.distance(dot * w.inverse / norm, m)


def normalised_windows(x: np.ndarray, m: int) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    dev = w.std(axis=1, keepdims=True)
    return (w - w.mean(axis=1, keepdims=True)) / np.where(dev < FLOOR, np.inf, dev)


def profile(x: np.ndarray, m: int, exclusion: int, left_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Nearest-neighbour distance and position of all windows of one short series.

    left_only: neighbours that stand before.  Windows without a neighbour have NaN and -1.
    """
    w = segments.Windows(x, m)
    _, _, best, at = segments.nearest(w, w, 0, max(1, exclusion), left_only, same=True)
    return np.where(np.isinf(best), np.nan, segments.distance(best, m)), at


def greedy_peaks(score: np.ndarray, radius: float, most: int, strict: bool = True, positive: bool = False) -> list[int]:
    """Positions by falling score that keep away from those taken before: those nearer than radius (or at it, unless
    strict) are passed over."""
    order = np.lexsort((np.arange(len(score)), -np.where(np.isnan(score), -np.inf, score)))
    taken: list[int] = []
    for i in order:
        if len(taken) >= most or np.isnan(score[i]) or (positive and score[i] <= 0):
            break
        if all(abs(int(i) - j) >= radius if strict else abs(int(i) - j) > radius for j in taken):
            taken.append(int(i))
    return taken


def _each(df: DataFrame, key: list[str], schema: str, run, extra: list[str] | None = None) -> DataFrame:
    """run(values, *extra) -> columns; a series' rows."""
    extra = extra or []
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key, *extra).schema)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                got = run(np.asarray(row[-1], float) if not isinstance(row[-1][0] if len(row[-1]) else 0.0, (list, np.ndarray)) else np.array([np.asarray(v, float) for v in row[-1]]), *row[len(key) : -1])
                out = pd.DataFrame(got)
                for i, c in reversed(list(enumerate([*key, *extra]))):
                    out.insert(0, c, row[i])
                yield out

    return df.select(*key, *extra, "values").mapInPandas(go, f"{own}, {schema}")


def gather(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Series as rows: key, values in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return df.groupBy(*key).agg(F.transform(pairs, lambda p: p["_v"]).alias("values"))


def matrix_profile(df: DataFrame, key: list[str], m: int, exclusion: int | None = None, left_only: bool = False, share: float = 1.0) -> DataFrame:
    """key, pos, dist, nn for every window of every series; the exclusion is a quarter of m unless given.

    Series are rows (key, pos, v), or one row each with values; pairs of segments are compared side by side.
    """
    gap = -(-m // 4) if exclusion is None else exclusion
    return segments.joined(df, key, F.array(F.lit(m)), lambda _: gap, left_only, share, size=TILE, longest=m).select(*key, "pos", "dist", "nn")


def left_discords(df: DataFrame, key: list[str], lengths: list[int], split: int, pruned: bool = True, count: bool = False) -> DataFrame:
    """key, m, score (normalised by 1 / (2 sqrt m)), pos: the best left discord of every series and length (see segments)."""
    return segments.left_discords(df, key, lengths, split, pruned, TILE, count)


def hinted(df: DataFrame, discords: DataFrame, key: list[str], middle: int) -> DataFrame:
    """discords, where those of other lengths are replaced by the window at the middle length's position if it scores higher.

    The position of the best discord of the middle length is a hint for the others: their left distance there is looked at too.
    """
    discords = kept(discords)
    hint = discords.where(F.col("m") == middle).select(*key, F.col("pos").alias("_hint"))
    rows = discords.join(hint, key, "left")
    longest = [r.m for r in discords.select("m").distinct().collect()]  # as many as lengths
    cut_up = segments.segmented(segments.long_form(df, key), key, max(longest, default=1), TILE)
    asked = rows.where("_hint <> pos and _hint >= m").select(*key, "m", F.col("_hint").alias("pos"))
    asked = asked.join(cut_up.where("seg = 0").select(*key, "n"), key).where("pos <= n - m").drop("n")
    asked = asked.withColumn("_look", F.sequence(F.lit(0).cast("long"), F.floor((F.col("pos") - F.col("m")) / TILE).cast("long")))
    asked = segments.windows_at(cut_up, asked, key, TILE).withColumn("seg", F.explode("_look"))

    def run(q: np.ndarray, pos: int, start: int, corr: np.ndarray) -> dict | None:
        best = float(corr[: max(0, pos - len(q) + 1 - start)].max(initial=-np.inf))
        return {"pos": [pos], "far": [float(segments.distance(np.array(best), len(q)))]} if best > -np.inf else None

    found = segments.queried(asked, cut_up, key, TILE, run, "pos long, far double", ["pos", "far"]).groupBy(*key, "m").agg((F.min("far") / (2 * F.sqrt("m"))).alias("_found"))
    better = F.coalesce(F.col("_found") > F.col("score"), F.lit(False))
    out = rows.join(found, [*key, "m"], "left")
    return out.select(*key, "m", F.when(better, F.col("_found")).otherwise(F.col("score")).alias("score"), F.when(better, F.col("_hint")).otherwise(F.col("pos")).alias("pos"))


def best_so_far(discords: DataFrame, key: list[str], percentile: float) -> DataFrame:
    """The best discords of each series, one a length, that reach a percentile (linear) of them, with rank by falling score."""
    floor = discords.groupBy(*key).agg(F.percentile("score", percentile).alias("_floor"))  # a series has as many as lengths
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "m"))
    return discords.join(floor, key).where("score >= _floor").withColumn("rank", rank).drop("_floor")


def fit_problems(df: DataFrame, key: list[str], shortest: int, longest: int, split: int) -> DataFrame:
    """(key, problem) for series that cannot be searched: short, split (nothing behind it), constant (for shortest values)."""
    run = F.aggregate(
        "values", F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("most")),
        lambda a, x: F.struct(x.alias("v"), F.when(x == a["v"], a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["most"], F.when(x == a["v"], a["n"] + 1).otherwise(1)).alias("most")),
    )["most"]
    size = F.size("values")
    found = F.array(F.when(size < longest, F.lit("short")), F.when(size <= split, F.lit("split")), F.when(run >= shortest, F.lit("constant")))
    return df.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def mass(df: DataFrame, key: list[str], start: int, m: int) -> DataFrame:
    """key, pos, dist: the distance profile of each series' own window at start, a segment at a time; null where there is none."""
    cut_up = segments.segmented(segments.long_form(df, key), key, m, TILE)
    asked = cut_up.where((F.col("seg") == 0) & (F.col("n") >= start + m)).select(*key, F.lit(m).alias("m"), F.lit(start).cast("long").alias("pos"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - m) / TILE).cast("long")).alias("_look"))
    asked = segments.windows_at(cut_up, asked, key, TILE).withColumn("seg", F.explode("_look"))

    def run(q: np.ndarray, pos: int, first: int, corr: np.ndarray) -> dict:
        some = corr > -np.inf
        return {"at": np.arange(len(corr)) + first, "dist": [float(d) if s else None for d, s in zip(segments.distance(np.where(some, corr, 0.0), m), some, strict=True)]}

    return segments.queried(asked, cut_up, key, TILE, run, "at long, dist double", ["at", "dist"]).select(*key, F.col("at").alias("pos"), "dist")


def anomalies(profiles: DataFrame, key: list[str], m: int, most: int = 5, percentile: float = 0.95) -> DataFrame:
    """key, rank, pos, score, confidence: greedy peaks at least m // 4 apart among scores from the percentile up."""
    floor = profiles.where("dist is not null").groupBy(*key).agg(F.percentile("dist", percentile).alias("_floor"))
    d = profiles.join(floor, key).where("dist >= _floor")
    rows = d.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "dist"))).alias("_p")).withColumn("values", F.transform("_p", lambda p: F.array(p["pos"].cast("double"), p["dist"])))

    def run(x: np.ndarray) -> dict:
        pos, score = x[:, 0].astype(np.int64), x[:, 1]
        full = np.full(int(pos.max()) + 1, np.nan)
        full[pos] = score
        at = greedy_peaks(full, m // 4, most)
        return {"rank": np.arange(1, len(at) + 1), "pos": at, "score": full[at], "confidence": full[at] / full[at[0]] if full[at[0]] > 0 else np.zeros(len(at))}

    return _each(rows, key, "rank int, pos long, score double, confidence double", run)


def greedy(df: DataFrame, key: list[str], radius: float, most: int, strict: bool = True, positive: bool = False) -> DataFrame:
    """key, rank, pos, score: greedy_peaks of each series' values."""

    def run(x: np.ndarray) -> dict:
        at = greedy_peaks(x, radius, most, strict, positive)
        return {"rank": np.arange(1, len(at) + 1), "pos": at, "score": x[at] if at else []}

    return _each(df, key, "rank int, pos long, score double", run)


def multivariate_anomalies(df: DataFrame, key: list[str], m: int, ratio: float) -> DataFrame:
    """key, pos (the window's centre), dist: the top share of windows by mean distance over the dimensions.

    Series are rows (key, pos, v) where v is an array with a value for each dimension.
    """
    each = F.array_sort(F.collect_list("dist"))  # a value a dimension, added in one order, so that equal windows tie
    mean = F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each))
    p = segments.multivariate(df, key, m, -(-m // 4)).groupBy(*key, "pos").agg(mean.alias("dist")).withColumn("pos", F.col("pos") + m // 2)
    w = Window.partitionBy(*key)
    p = p.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc_nulls_last("dist"), F.desc("pos"))))
    return p.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_n", "_r")
