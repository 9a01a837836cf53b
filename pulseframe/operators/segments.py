"""Self-similarity joins of long series in blocks.

A series (rows key, pos from 0, v) is cut into segments of ``SEGMENT`` windows, each with the values that its last windows need
beyond it.  A pair of segments is the unit of work and of shuffle: no task holds a series, and the bytes moved are those of
the pairs.  In a pair the covariances of one window with all of the other segment's follow from those of the window before,
cov(i, j) = cov(i - 1, j - 1) + df(i) dg(j) + dg(i) df(j), seeded at the block's edges and anew every ``RESEED`` rows.  They are sums of
centred values, so distances do not depend on the offset of a series.

A value may be an array of dimensions: then a pair runs the products of all dimensions of a row side by side.

Defined cases: windows that do not vary, or hold a null or NaN, have no distance (to anything, or from anything); a series shorter than a window has no
rows; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Windows of a segment; rows after which products are computed anew; deviation under which a window is flat; and one window in
#: so many is looked up by itself, more by rows.
SEGMENT, RESEED, FLAT, SPARSE = 8192, 512, 1e-5, 6
#: Distances that are equal: two windows that are each other's nearest have one distance, up to rounding.
SAME = 1e-9
_CHUNK = 1 << 20


class Windows:
    """All windows of m values of a segment: means, inverse lengths of the centred windows, and the terms of the recurrence."""

    def __init__(self, x: np.ndarray, m: int, most: int | None = None) -> None:
        missing = np.isnan(x)
        x = np.where(missing, 0.0 if missing.all() else np.nanmean(x), x) if missing.any() else x
        self.x, self.m = x - (x.mean() if len(x) else 0.0), m
        self.n = max(0, len(x) - m + 1) if most is None else max(0, min(most, len(x) - m + 1))
        self.x = self.x[: self.n + m - 1]
        self.mean, norm = np.zeros(self.n), np.zeros(self.n)
        step = max(1, _CHUNK // m)
        for at in range(0, self.n, step):
            w = np.lib.stride_tricks.sliding_window_view(self.x[at : min(self.n, at + step) + m - 1], m)
            mean = w.mean(axis=1)
            self.mean[at : at + step] = mean
            norm[at : at + step] = np.sqrt(((w - mean[:, None]) ** 2).sum(axis=1))
        self.flat = norm <= FLAT * np.sqrt(m)
        if missing.any():
            upto = np.concatenate(([0], np.cumsum(missing)))
            self.flat |= (upto[m : m + self.n] - upto[: self.n]) > 0
        self.inverse = np.where(self.flat, 0.0, 1 / np.where(self.flat, 1.0, norm))
        self.df, self.dg = np.zeros(self.n), np.zeros(self.n)
        old, new = self.x[: max(0, self.n - 1)], self.x[m : m + max(0, self.n - 1)]
        self.df[1:] = (new - old) / 2
        self.dg[1:] = (new - self.mean[1:]) + (old - self.mean[:-1])

    def covariances(self, w: np.ndarray) -> np.ndarray:
        """Of all windows with one that is centred."""
        return np.correlate(self.x, w, "valid")

    def centred(self, i: int) -> np.ndarray:
        return self.x[i : i + self.m] - self.mean[i]


def distance(correlation: np.ndarray, m: int) -> np.ndarray:
    return np.sqrt(np.maximum(2 * m * (1 - correlation), 0))


def rows_of(a: Windows, b: Windows) -> Iterator[tuple[int, np.ndarray]]:
    """For each window of a: its covariances with all of b's."""
    first = a.covariances(b.centred(0)) if a.n and b.n else np.zeros(0)
    cov = np.zeros(b.n)
    for i in range(a.n if b.n else 0):
        if i % RESEED == 0:
            cov = b.covariances(a.centred(i))
        else:
            after = np.empty_like(cov)
            np.multiply(b.dg[1:], a.df[i], out=after[1:])
            after[1:] += cov[:-1]
            after[1:] += b.df[1:] * a.dg[i]
            after[0] = first[i]
            cov = after
        yield i, cov


def nearest(a: Windows, b: Windows, shift: int, exclusion: int, left_only: bool, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greatest correlation and its place: of a's windows among b's, and of b's among a's; b begins shift windows after a.

    Pairs of windows less than exclusion apart do not count.  left_only: only b's windows look, at those before.  same: b is a.
    """
    best_a, at_a, best_b, at_b = np.full(a.n, -np.inf), np.full(a.n, -1), np.full(b.n, -np.inf), np.full(b.n, -1)
    barred = np.where(b.flat, -np.inf, 0.0)
    some = bool(b.flat.any())
    for i, cov in rows_of(a, b):
        if a.flat[i]:
            continue
        c = cov * b.inverse
        c *= a.inverse[i]
        if some:
            c += barred
        low, high = max(0, i - shift - exclusion + 1), max(0, i - shift + exclusion)
        c[(0 if left_only else low) : high] = -np.inf
        better = c > best_b
        np.copyto(best_b, c, where=better)
        at_b[better] = i
        if not left_only and not same and len(c):
            k = int(c.argmax())
            if c[k] > -np.inf:
                best_a[i], at_a[i] = c[k], k
    return best_a, at_a, best_b, at_b


def nearest_by_diagonals(a: Windows, b: Windows, shift: int, gaps: np.ndarray, left_only: bool, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same over some diagonals only: pairs of windows that stand a gap apart."""
    best_a, at_a, best_b, at_b = np.full(a.n, -np.inf), np.full(a.n, -1), np.full(b.n, -np.inf), np.full(b.n, -1)
    if not a.n or not b.n:
        return best_a, at_a, best_b, at_b
    row, column = b.covariances(a.centred(0)), a.covariances(b.centred(0))
    for g in gaps.tolist():
        i, j = max(0, shift - g), max(0, g - shift)
        k = min(a.n - i, b.n - j)
        if k <= 0:
            continue
        step = a.df[i : i + k] * b.dg[j : j + k] + a.dg[i : i + k] * b.df[j : j + k]
        step[0] = row[j] if i == 0 else column[i]
        c = np.cumsum(step) * a.inverse[i : i + k] * b.inverse[j : j + k]
        c[a.flat[i : i + k] | b.flat[j : j + k]] = -np.inf
        better = c > best_b[j : j + k]
        best_b[j : j + k][better], at_b[j : j + k][better] = c[better], np.flatnonzero(better) + i
        if not left_only:
            best, at = (best_b, at_b) if same else (best_a, at_a)
            better = c > best[i : i + k]
            best[i : i + k][better], at[i : i + k][better] = c[better], np.flatnonzero(better) + j
    return best_a, at_a, best_b, at_b


def nearest_of_many(a: list[Windows], b: list[Windows], shift: int, exclusion: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row d: for each window the smallest mean of the d + 1 best dimensions' distances to a window of the other segment.

    Flat windows count as zeros.  Memory is one row of all dimensions.  A pair's distance is computed once and counts for both
    windows, so two that are each other's nearest tie exactly.
    """
    dims, m = len(a), a[0].m
    best_a, best_b = np.full((dims, a[0].n), np.inf), np.full((dims, b[0].n), np.inf)
    share = np.arange(1, dims + 1)[:, None]
    inverse = np.stack([w.inverse for w in b])
    for rows in zip(*[rows_of(x, y) for x, y in zip(a, b, strict=True)], strict=True):
        i = rows[0][0]
        c = np.stack([cov for _, cov in rows]) * inverse * np.array([w.inverse[i] for w in a])[:, None]
        d = np.cumsum(np.sort(distance(c, m), axis=0), axis=0) / share
        d[:, max(0, i - shift - exclusion + 1) : max(0, i - shift + exclusion)] = np.inf
        if same:
            d[:, :i] = np.inf
            best_b[:, i] = np.minimum(best_b[:, i], d.min(axis=1, initial=np.inf))
        else:
            best_a[:, i] = d.min(axis=1, initial=np.inf)
        np.minimum(best_b, d, out=best_b)
    return best_a, best_b


def long_form(df: DataFrame, key: list[str]) -> DataFrame:
    """key, pos, v of series that are rows already, or columns with values."""
    return df.select(*key, "pos", "v") if "pos" in df.columns else df.select(*key, F.posexplode("values").alias("pos", "v"))


def segmented(df: DataFrame, key: list[str], longest: int, size: int) -> DataFrame:
    """key, seg, segs (of the series), n (values of the series), values: segments of size windows and longest - 1 values more."""
    pos = F.col("pos").cast("long")
    low = F.greatest(F.lit(0).cast("long"), F.ceil((pos - (size + longest - 2)) / size).cast("long"))
    cut_up = df.select(*key, pos.alias("pos"), "v", F.explode(F.sequence(low, F.floor(pos / size).cast("long"))).alias("seg"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"])
    parts = kept(cut_up.groupBy(*key, "seg").agg(gathered.alias("values")))
    last = parts.groupBy(*key).agg((F.max("seg") + 1).alias("segs"), F.max(F.col("seg") * size + F.size("values")).alias("n"))
    return parts.join(last, key)


def in_units(rows: DataFrame, key: list[str], unit: list[str], order: list[str], run: Callable[..., dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """run(the unit's values, its rows) -> columns, for each (key, unit), streamed; a unit's rows are few."""
    by = [*key, *unit]

    def flush(found: list[tuple[tuple, dict[str, np.ndarray]]]) -> pd.DataFrame:
        each = [len(next(iter(c.values()))) for _, c in found]
        keys = {c: np.repeat(np.array([own[k] for own, _ in found]), each) for k, c in enumerate(key)}
        return pd.DataFrame(keys | {c: np.concatenate([got[c] for _, got in found]) for c in found[0][1]})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        own: tuple | None = None
        for b in batches:
            if not len(b):
                continue
            names = list(zip(*[b[c].to_list() for c in by], strict=True))
            edges = [0, *[k for k in range(1, len(b)) if names[k] != names[k - 1]], len(b)]
            found = []
            for x, y in zip(edges, edges[1:], strict=False):
                if own is not None and names[x] != own:
                    found.append((own, run(own, pd.concat(held) if len(held) > 1 else held[0])))
                    held = []
                own = names[x]
                held.append(b.iloc[x:y])
            if found := [f for f in found if f[1] is not None]:
                yield flush(found)
        if own is not None and (got := run(own, pd.concat(held))) is not None:
            yield flush([(own, got)])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by).sortWithinPartitions(*by, *order).mapInPandas(go, schema)


def key_schema(df: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)


def paired(segments: DataFrame, key: list[str], lengths: Column, size: int, most_apart: int | None = None) -> DataFrame:
    """Each segment once for every length and pair that it is in: key, m, lo, hi, seg, values; pairs without windows are left out."""
    s = segments.withColumn("m", F.explode(lengths)).where("n >= m")
    with_windows = F.ceil((F.col("n") - F.col("m") + 1) / size).cast("long")  # segments that a window of m begins in
    s = s.withColumn("_segs", with_windows).where("seg < _segs")
    first, last = F.lit(0).cast("long"), F.col("_segs") - 1
    if most_apart is not None:
        first, last = F.greatest(first, F.col("seg") - most_apart), F.least(last, F.col("seg") + most_apart)
    s = s.withColumn("_other", F.explode(F.sequence(first, last)))
    return s.select(*key, "m", F.least("seg", "_other").alias("lo"), F.greatest("seg", "_other").alias("hi"), "seg", "values")


def joined(df: DataFrame, key: list[str], lengths: Column, exclusion: Callable[[int], int], left_only: bool = False, share: float = 1.0, seed: int = 1, size: int | None = None, most_apart: int | None = None, longest: int = 0, segments: DataFrame | None = None, flat: bool = True) -> DataFrame:
    """key, m, pos, dist, nn: every window's nearest (the earliest of several) by pairs of segments; without one null and null.

    share: of the diagonals, drawn by hash.  most_apart: only pairs of segments so near.  flat: also windows that have no distance.
    """
    size = size or SEGMENT
    segments = segmented(long_form(df, key), key, longest, size) if segments is None else segments
    rows = paired(segments, key, lengths, size, most_apart)

    def run(own: tuple, b: pd.DataFrame) -> pd.DataFrame:
        *_, m, lo, hi = own
        xs = [Windows(np.asarray(v, float), m, size) for v in b["values"]]
        x, y, same = xs[0], xs[-1], lo == hi
        gap, shift = exclusion(m), (hi - lo) * size
        if share < 1:
            gaps = np.arange(max(1, gap, shift - x.n + 1), shift + y.n)
            draw = (gaps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(11)
            draw = (draw ^ (draw >> np.uint64(23))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
            best_x, at_x, best_y, at_y = nearest_by_diagonals(x, y, shift, gaps[draw < np.uint64(int(share * 2**32))], left_only, same)
        else:
            best_x, at_x, best_y, at_y = nearest(x, y, shift, max(1, gap), left_only, same)
        out = [(hi, best_y, at_y + lo * size)]
        if not same and not left_only:
            out.append((lo, best_x, at_x + hi * size))
        at = np.concatenate([np.arange(len(best)) + seg * size for seg, best, _ in out])
        done = {"m": np.full(len(at), m), "pos": at, "corr": np.concatenate([o[1] for o in out]), "nn": np.concatenate([o[2] for o in out])}
        if flat:
            return done
        some = ~np.concatenate([y.flat, x.flat][: len(out)])
        return {c: v[some] for c, v in done.items()}

    each = in_units(rows, key, ["m", "lo", "hi"], ["seg"], run, f"{key_schema(df, key)}, m int, pos long, corr double, nn long")
    best = F.max(F.when(F.col("corr") > float("-inf"), F.struct("corr", (-F.col("nn")).alias("before")))).alias("_b")
    far = F.when(F.col("_b").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("m") * (1 - F.col("_b.corr")))))
    return each.groupBy(*key, "m", "pos").agg(best).select(*key, "m", "pos", far.alias("dist"), (-F.col("_b.before")).alias("nn"))


def queried(queries: DataFrame, segments: DataFrame, key: list[str], size: int, run: Callable[[np.ndarray, int, int, np.ndarray], Any], schema: str, names: list[str]) -> DataFrame:
    """run(query, its pos, first pos of the segment, the segment's correlations with it) for each query and segment that it names.

    queries: key, m, pos, seg (to look at), query (array of m values).  run gives rows of names or None.
    """
    looked = queries.select(*key, "seg").distinct()
    both = segments.join(looked, [*key, "seg"]).select(*key, "seg", F.lit(None).cast("int").alias("m"), F.lit(None).cast("long").alias("pos"), F.col("values").cast("array<double>").alias("query"))
    rows = both.unionByName(queries.select(*key, "seg", F.col("m").cast("int").alias("m"), "pos", F.col("query").cast("array<double>").alias("query")))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, x, known = None, np.zeros(0), {}
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                unit = tuple(row[: len(key) + 1])
                if unit != own or pd.isna(row[-3]):
                    own, x, known = unit, np.asarray(row[-1], float), {}  # the segment comes before its queries
                    continue
                m, pos = int(row[-3]), int(row[-2])
                if m not in known:
                    known = {m: Windows(x, m, size)}
                w = known[m]
                q = np.asarray(row[-1], float)
                q = q - q.mean()
                q -= q.mean()  # what the first mean's rounding left of a large offset
                norm = np.sqrt((q * q).sum())
                corr = np.where(w.flat, -np.inf, w.covariances(q) * w.inverse / norm) if norm > FLAT * np.sqrt(m) and w.n else np.full(w.n, -np.inf)
                got = run(q, pos, unit[-1] * size, corr)
                if got is not None:
                    out.append(pd.DataFrame(got).assign(**dict(zip(key, unit, strict=False)), m=m)[[*key, "m", *names]])
            if out:
                yield pd.concat(out)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *key, "seg").sortWithinPartitions(*key, "seg", F.col("m").asc_nulls_first(), "pos")
    return dealt.mapInPandas(search, f"{key_schema(segments, key)}, m int, {schema}")


def windows_at(segments: DataFrame, wanted: DataFrame, key: list[str], size: int) -> DataFrame:
    """wanted (key, m, pos and more) with query: the window of m values at pos, from the segment where it begins."""
    at = wanted.withColumn("_seg", F.floor(F.col("pos") / size).cast("long"))
    s = segments.select(*key, F.col("seg").alias("_seg"), F.col("values").alias("_values"))
    return at.join(s, [*key, "_seg"]).withColumn("query", F.slice("_values", (F.col("pos") - F.col("_seg") * size + 1).cast("int"), F.col("m"))).drop("_values")


def left_discords(df: DataFrame, key: list[str], lengths: list[int], split: int, pruned: bool = True, size: int | None = None, count: bool = False) -> DataFrame:
    """key, m, score (normalised by 1 / (2 sqrt m)), pos: the best left discord of every series and length of at least 2 m values.

    A window at split or later, with more than m windows before, scores the distance to its nearest at least m before; equal
    scores go to the earlier window; without any the score is 0 and pos -1.  count: also looked, the window pairs compared.

    Not pruned: all pairs of segments.  Pruned: first every segment is joined with itself and the one before, which bounds its windows
    from above; the most promising window of each segment is then compared with all that stands before, and the largest of these
    distances is the series' bound.  Windows under it are out; the others look back over twice as many segments in each round,
    with the bound checked in between, so the best score and place are those of the exact search.
    """
    size = max(size or SEGMENT, *lengths)  # so that every window has others before it in its segment and the one before
    segments = segmented(long_form(df, key), key, max(lengths), size)
    sizes = segments.where("seg = 0").select(*key, "segs", "n", F.explode(F.array(*map(F.lit, lengths))).alias("m")).where("n >= 2 * m")
    lengths_of = F.array(*map(F.lit, lengths))
    usable = F.col("pos") >= F.greatest(F.col("m") + 1, F.lit(split))
    near = joined(df, key, lengths_of, lambda m: m, left_only=True, size=size, most_apart=1 if pruned else None, segments=segments, flat=False)
    cells = F.lit(size).cast("long") * size
    if not pruned:
        found = near.where(usable & F.col("dist").isNotNull())
        looked = sizes.select(*key, "m", (F.ceil((F.col("n") - F.col("m") + 1) / size) * (F.ceil((F.col("n") - F.col("m") + 1) / size) + 1) / 2 * cells).cast("long").alias("looked"))
    else:
        near = near.where(usable).withColumn("dist", F.coalesce("dist", F.lit(float("inf"))))
        near = kept(near.select(*key, "m", "pos", "dist").withColumn("seg", F.floor(F.col("pos") / size).cast("long")))
        done, looked = [near.where("seg <= 1").select(*key, "m", "pos", "dist")], []
        rank = F.row_number().over(Window.partitionBy(*key, "m", "seg").orderBy(F.desc("dist"), "pos"))
        open_ = near.where("seg > 1")
        if open_.limit(1).count():
            lead = open_.withColumn("_r", rank).where("_r = 1").drop("_r")
            looked.append(lead.groupBy(*key, "m").agg((F.sum("seg") - F.count("*")).alias("looked")))
            lead = kept(_closer(lead, F.sequence(F.lit(0).cast("long"), F.col("seg") - 2), segments, key, size))
            done.append(lead.select(*key, "m", "pos", "dist"))
            every = done[0].unionByName(done[1]).where(F.col("dist") < float("inf"))
            bound = kept(every.groupBy(*key, "m").agg(F.max("dist").alias("bound")))  # one row a series and length
            left = open_.join(lead.select(*key, "m", "pos"), [*key, "m", "pos"], "left_anti")
            back, step = 2, 1
            while True:
                left = kept(left.join(bound, [*key, "m"], "left").where(F.col("bound").isNull() | (F.col("dist") >= F.col("bound") - SAME)).drop("bound"))  # an equal one may stand earlier
                over = left.where(F.col("seg") < back)
                done.append(over.select(*key, "m", "pos", "dist"))
                left = left.where(F.col("seg") >= back)
                if not left.limit(1).count():
                    break
                first = F.greatest(F.lit(0).cast("long"), F.col("seg") - (back + step - 1))
                looked.append(left.groupBy(*key, "m").agg(F.sum(F.col("seg") - back - first + 1).alias("looked")))
                left, back, step = _closer(left, F.sequence(first, F.col("seg") - back), segments, key, size), back + step, 2 * step
        found = done[0]
        for d in done[1:]:
            found = found.unionByName(d)
        found = found.where(F.col("dist") < float("inf"))
        looked = [x.withColumn("looked", F.col("looked") * size) for x in looked]
        looked = _total([*looked, sizes.select(*key, "m", ((2 * F.ceil((F.col("n") - F.col("m") + 1) / size) - 1) * cells).cast("long").alias("looked"))], key)
    best = F.max(F.struct(F.round(F.col("dist") / SAME).alias("step"), (-F.col("pos")).alias("before"), "dist")).alias("_b")
    out = sizes.select(*key, "m").join(found.groupBy(*key, "m").agg(best), [*key, "m"], "left")
    out = out.select(*key, "m", (F.coalesce("_b.dist", F.lit(0.0)) / (2 * F.sqrt("m"))).alias("score"), F.coalesce(-F.col("_b.before"), F.lit(-1)).cast("long").alias("pos"))
    return out.join(looked, [*key, "m"], "left") if count else out


def _total(parts: list[DataFrame], key: list[str]) -> DataFrame:
    return _all(parts).groupBy(*key, "m").agg(F.sum("looked").alias("looked"))


def range_discords(df: DataFrame, key: list[str], lengths: list[int], shrink: float = 0.75, size: int | None = None) -> DataFrame:
    """key, m, score (normalised by 1 / (2 sqrt m)), pos: the best discord of every series and length of at least 2 m values, lengths side by side.

    A window scores the distance to its nearest that does not overlap it; equal scores go to the earlier window; without any the
    score is 0 and pos -1.  Segments and their neighbours bound all windows from above.  Candidates of a series and length are the
    windows whose bound reaches its range; they are compared with all other segments, so their distances are exact.  If the best of them is
    no less than every other bound it is the discord, else the range falls: to that best distance, or by shrink where that is less.
    """
    size = max(size or SEGMENT, *lengths)
    segments = segmented(long_form(df, key), key, max(lengths), size)
    sizes = segments.where("seg = 0").select(*key, "segs", "n", F.explode(F.array(*map(F.lit, lengths))).alias("m")).where("n >= 2 * m")
    near = joined(df, key, F.array(*map(F.lit, lengths)), lambda m: m, size=size, most_apart=1, segments=segments, flat=False)
    near = near.select(*key, "m", "pos", F.coalesce("dist", F.lit(float("inf"))).alias("dist"), F.floor(F.col("pos") / size).cast("long").alias("seg"))
    open_ = kept(near.join(sizes.select(*key, "m", "segs"), [*key, "m"]))
    most = F.least(F.max("dist"), 2 * F.sqrt("m"))  # no distance is larger
    reach = kept(open_.groupBy(*key, "m").agg((0.9 * most).alias("range")))
    found = []
    while open_.limit(1).count():
        d = open_.join(reach, [*key, "m"])
        before = F.when(F.col("seg") >= 2, F.sequence(F.lit(0).cast("long"), F.col("seg") - 2)).otherwise(F.array().cast("array<bigint>"))
        after = F.when(F.col("seg") + 2 < F.col("segs"), F.sequence(F.col("seg") + 2, F.col("segs") - 1)).otherwise(F.array().cast("array<bigint>"))
        some = kept(d.where("dist >= range").select(*key, "m", "pos", "dist", "seg", "segs"))
        looks = some.select(*key, "m", "seg", "segs", "pos", "dist").withColumn("_look", F.concat(before, after))
        exact = kept(_closer(looks, F.col("_look"), segments, key, size).select(*key, "m", "pos", "dist"))
        found.append(exact.where(F.col("dist") < float("inf")))
        rest = d.where("dist < range").drop("range")
        best = _all(found).groupBy(*key, "m").agg(F.max("dist").alias("best"))
        left = kept(rest.join(best, [*key, "m"], "left").where(F.col("best").isNull() | (F.col("dist") >= F.col("best") - SAME)))  # an equal one may stand earlier
        reach = kept(left.select(*key, "m", "best").distinct().join(reach, [*key, "m"]).select(*key, "m", F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("range") > 1e-3, F.col("range") * shrink).otherwise(0.0)).alias("range")))
        open_ = left.drop("best")
    top = F.max(F.struct(F.round(F.col("dist") / SAME).alias("step"), (-F.col("pos")).alias("before"), "dist")).alias("_b")
    out = sizes.select(*key, "m")
    if not found:
        return out.withColumns({"score": F.lit(0.0), "pos": F.lit(-1).cast("long")})
    out = out.join(_all(found).groupBy(*key, "m").agg(top), [*key, "m"], "left")
    return out.select(*key, "m", (F.coalesce("_b.dist", F.lit(0.0)) / (2 * F.sqrt("m"))).alias("score"), F.coalesce(-F.col("_b.before"), F.lit(-1)).cast("long").alias("pos"))


def _all(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _closer(rows: DataFrame, look: Column, segments: DataFrame, key: list[str], size: int) -> DataFrame:
    """rows (key, m, pos, dist, seg) with dist lowered to what the segments in look hold; these are two or more from the window's own.

    The unit is a pair of segments and the places of the windows that look; no window travels by itself.
    """
    asked = rows.withColumn("_to", look).groupBy(*key, "m", "seg", "_to").agg(F.collect_list("pos").alias("who")).select(*key, "m", "seg", "who", F.explode("_to").alias("lo"))  # size places at most
    own = segments.select(*key, "seg", F.col("values").alias("own"))
    before = segments.select(*key, F.col("seg").alias("lo"), F.col("values").alias("before"))
    units = asked.join(own, [*key, "seg"]).join(before, [*key, "lo"]).select(*key, "m", "seg", "who", "own", "before")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                m, seg, who, own, before = row[len(key) :]
                who = np.sort(np.asarray(who, np.int64))
                best = greatest(Windows(np.asarray(own, float), m, size), Windows(np.asarray(before, float), m, size), who - seg * size)
                some = best > -np.inf
                out.append(pd.DataFrame({"m": m, "pos": who[some], "found": distance(best[some], m)}).assign(**dict(zip(key, row, strict=False))))
            if out:
                yield pd.concat(out)[[*key, "m", "pos", "found"]]

    got = units.mapInPandas(search, f"{key_schema(segments, key)}, m int, pos long, found double").groupBy(*key, "m", "pos").agg(F.min("found").alias("found"))
    return rows.join(got, [*key, "m", "pos"], "left").withColumn("dist", F.least("dist", F.coalesce("found", "dist"))).drop("found")


def greatest(a: Windows, b: Windows, who: np.ndarray) -> np.ndarray:
    """The greatest correlation of some of a's windows with any of b's.

    Many windows run through all rows, few each take a Fourier product; their best is computed anew without its rounding.
    """
    out, barred = np.full(len(who), -np.inf), np.where(b.flat, -np.inf, 0.0)
    if not b.n:
        return out
    if len(who) * SPARSE > a.n:
        place = np.full(a.n, -1)
        place[who] = np.arange(len(who))
        for i, cov in rows_of(a, b):
            if place[i] >= 0 and not a.flat[i]:
                out[place[i]] = (cov * b.inverse + barred).max() * a.inverse[i]
        return out
    full = 1 << int(np.ceil(np.log2(len(b.x) + a.m)))
    image = np.fft.rfft(b.x, full)
    for at in range(0, len(who), 16):
        q = np.stack([a.centred(i) for i in who[at : at + 16]])
        c = np.fft.irfft(np.fft.rfft(q[:, ::-1], full) * image, full)[:, a.m - 1 : len(b.x)] * b.inverse + barred
        for k, j in enumerate(c.argmax(axis=1).tolist()):
            i = who[at + k]
            if not a.flat[i] and not b.flat[j]:
                out[at + k] = (q[k] @ b.centred(j)) * a.inverse[i] * b.inverse[j]
    return out


def multivariate(df: DataFrame, key: list[str], m: int, exclusion: int, size: int | None = None) -> DataFrame:
    """key, pos, k, dist: for each window the smallest mean of its k best dimensions' distances; v is an array of dimensions."""
    size = size or SEGMENT // 2
    rows = paired(segmented(df.select(*key, "pos", "v"), key, m, size), key, F.array(F.lit(m)), size)

    def run(own: tuple, b: pd.DataFrame) -> pd.DataFrame:
        *_, lo, hi = own
        xs = [[Windows(x, m, size) for x in np.array([np.asarray(v, float) for v in values]).T] for values in b["values"]]
        best_x, best_y = nearest_of_many(xs[0], xs[-1], (hi - lo) * size, exclusion, lo == hi)
        parts = [(hi, best_y)] if lo == hi else [(hi, best_y), (lo, best_x)]
        at = [np.tile(np.arange(d.shape[1]) + seg * size, len(d)) for seg, d in parts]
        return {"pos": np.concatenate(at), "k": np.concatenate([np.repeat(np.arange(1, len(d) + 1), d.shape[1]) for _, d in parts]), "dist": np.concatenate([d.ravel() for _, d in parts])}

    each = in_units(rows, key, ["m", "lo", "hi"], ["seg"], run, f"{key_schema(df, key)}, pos long, k int, dist double")
    return each.groupBy(*key, "pos", "k").agg(F.min(F.when(F.col("dist") < float("inf"), F.col("dist"))).alias("dist"))
