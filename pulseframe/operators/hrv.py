"""Rules over heart-rate features: baselines, cutoffs, parameter metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio
from .sequence import in_windows, ordered, pad

DAY = 24 * 3600 * 1_000_000


def baseline_cutoff(df: DataFrame, key: list[str], recording: str, t: str, value: str, label: str, factor: float = 1.05, first_only: bool = False) -> DataFrame:
    """key, cutoff: factor times the largest value in the baseline; 0.0 without any.

    The baseline is the first day if all recordings together last over two, else half of them.  Labelled rows do not count; a
    recording takes from its first unlabelled row what the ones before have left.  What is left is sequential over the
    recordings, whose spans are aggregated first; only these few rows are walked.
    """
    spans = df.groupBy(*key, recording).agg((F.max(t) - F.min(t)).alias("_d"))
    total = spans.groupBy(*key).agg(F.sum("_d").alias("_total"))
    total = total.withColumn("_base", F.when(F.col("_total") > 2 * DAY, F.lit(float(DAY))).otherwise(F.col("_total") / 2.0)).select(*key, "_base")
    rows = df.where(F.col(label) == 0).select(*key, recording, t, F.col(value).cast("double").alias("_v")).join(total, key)
    columns = [*key, "_base", recording, t, "_v"]
    dealt = rows.select(*columns).repartition(*key).sortWithinPartitions(*key, recording, t)
    n = len(key)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema), "best double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, rec, left, start, last, best, count = None, None, 0.0, 0, 0, None, 0
        out: list[tuple] = []
        for b in batches:
            for row in b.itertuples(index=False):
                if row[:n] != name:
                    if name is not None:
                        out.append((*name, best))
                    name, rec, left, best, count = row[:n], None, row[n], None, 0
                if row[n + 1] != rec:
                    if rec is not None:
                        left -= last - start
                    rec, start, last, count = row[n + 1], row[n + 2], row[n + 2], count + 1
                if left > 0 and row[n + 2] <= start + left and (count == 1 or not first_only):
                    last = row[n + 2]
                    if row[n + 3] == row[n + 3] and (best is None or row[n + 3] > best):
                        best = row[n + 3]
            yield pd.DataFrame(out, columns=[*key, "best"])
            out = []
        if name is not None:
            yield pd.DataFrame([(*name, best)], columns=[*key, "best"])

    found = dealt.mapInPandas(run, schema)
    return found.select(*key, F.coalesce(F.col("best") * factor, F.lit(0.0)).alias("cutoff"))


def parameter_counts(alarms: DataFrame, truth: DataFrame, hours: DataFrame, parameter: str, key: list[str], subject: str, position: str, tolerance: int, parameters: list[str]) -> DataFrame:
    """(parameter, subject): n_true, n_found, n_pred, n_ok, hours; an alarm and an event meet within the tolerance."""
    names = F.explode(F.array(*[F.lit(p) for p in parameters])).alias(parameter)
    both = alarms.select(parameter, *key, subject, position, F.lit(1).alias("_a"), F.lit(0).alias("_e")).unionByName(truth.select(names, *key, subject, position, F.lit(0).alias("_a"), F.lit(1).alias("_e")))
    w = Window.partitionBy(parameter, *key).orderBy(position).rangeBetween(-tolerance, tolerance)
    m = both.withColumn("_na", F.max("_a").over(w)).withColumn("_ne", F.max("_e").over(w))
    g = m.groupBy(parameter, subject).agg(F.sum("_e").alias("n_true"), F.sum(F.col("_e") * F.col("_na")).alias("n_found"), F.sum("_a").alias("n_pred"), F.sum(F.col("_a") * F.col("_ne")).alias("n_ok"))
    return g.where("n_true > 0").join(hours, subject)


def parameter_metrics(counts: DataFrame) -> DataFrame:
    s, p = ratio(F.col("n_found"), F.col("n_true")), ratio(F.col("n_ok"), F.col("n_pred"))
    d = counts.withColumn("sensitivity", s).withColumn("prec", p)
    d = d.withColumn("f1", F.when(F.col("prec") + F.col("sensitivity") > 0, 2 * F.col("prec") * F.col("sensitivity") / (F.col("prec") + F.col("sensitivity"))))
    return d.withColumn("fa_per_day", F.when(F.col("hours") > 0, (F.col("n_pred") - F.col("n_ok")) / (F.col("hours") / 24)))


def excluded_predictions(df: DataFrame, key: list[str], order: list[str], label: str, filtered: str, predicted: str, rows: int) -> DataFrame:
    """counted and excluded predictions of each series: excluded within rows of where only the unfiltered label is set."""
    only = F.when((F.col(label) == 1) & (F.col(filtered) == 0), 1).otherwise(0)
    d = df.withColumn("_x", pad(only, ordered(key, order), rows, rows))
    hit = F.col(predicted).cast("long")
    return d.groupBy(*key).agg(F.sum(hit * (1 - F.col("_x"))).alias("counted"), F.sum(hit * F.col("_x")).alias("excluded"))


def island_hits(df: DataFrame, key: list[str], order: list[str], label: str, predicted: str) -> DataFrame:
    """key, islands, hit: labelled runs, and those with any prediction inside."""
    w = ordered(key, order)
    on = F.col(label) == 1
    d = df.withColumn("_new", (on & (F.coalesce(F.lag(label).over(w), F.lit(0)) == 0)).cast("int"))
    d = d.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(on)
    return d.groupBy(*key, "_i").agg(F.max(F.col(predicted).cast("int")).alias("_h")).groupBy(*key).agg(F.count("*").alias("islands"), F.sum("_h").alias("hit"))



def sliding_rate(beats: DataFrame, key: list[str], t: str, width: int, stride: int, per: float) -> DataFrame:
    """key, k, beats, rate: ``per`` over the mean interval of the beats in [k * stride, k * stride + width), from two beats on."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(t) - width) / stride).cast("long") + 1)
    w = beats.withColumn("k", F.explode(F.sequence(first, F.floor(F.col(t) / stride).cast("long"))))
    g = w.groupBy(*key, "k").agg(F.count("*").alias("beats"), (F.max(t) - F.min(t)).alias("_span")).where("beats >= 2 and _span > 0")
    return g.select(*key, "k", "beats", (F.lit(per) / (F.col("_span") / (F.col("beats") - 1))).alias("rate"))


def time_domain(df: DataFrame, key: list[str], position: str, value: str, width: int, stride: int, low: float, high: float) -> DataFrame:
    """Time-domain features of the intervals in every whole window that another interval follows.

    Windows with an interval under low or over high are left out.  Percentages are of steps; the median absolute deviation
    is scaled by 1.4826 to that of a normal distribution.
    """
    step = F.col(value) - F.lag(value).over(ordered(key, [position]))
    d = df.select(*key, position, F.col(value).cast("double").alias("_v"), step.alias("_d"), F.count("*").over(Window.partitionBy(*key)).alias("_n"))
    w = in_windows(d, key, position, width, stride).where(F.col("window_index") * stride + width < F.col("_n"))
    inner = lambda c: F.when(F.col(position) > F.col("window_index") * stride, c)
    over = lambda x: 100 * F.avg(inner((F.abs("_d") > x).cast("double")))
    g = w.groupBy(*key, "window_index").agg(
        F.avg("_v").alias("mean_nn"), F.stddev_samp("_v").alias("sdnn"), F.sqrt(F.avg(inner(F.col("_d") * F.col("_d")))).alias("rmssd"), F.stddev_samp(inner(F.col("_d"))).alias("sdsd"),
        F.percentile("_v", 0.5).alias("median_nn"), (F.percentile("_v", 0.75) - F.percentile("_v", 0.25)).alias("iqr_nn"), F.percentile("_v", 0.2).alias("prc20_nn"), F.percentile("_v", 0.8).alias("prc80_nn"),
        over(50).alias("pnn50"), over(20).alias("pnn20"), F.min("_v").alias("min_nn"), F.max("_v").alias("max_nn"), F.collect_list("_v").alias("_all"),
    )
    g = g.where((F.col("min_nn") >= low) & (F.col("max_nn") <= high))
    far = F.array_sort(F.transform("_all", lambda x: F.abs(x - F.col("median_nn"))))  # width values
    mad = F.lit(1.4826) * (F.element_at(far, (width + 1) // 2) + F.element_at(far, width // 2 + 1)) / 2
    g = g.withColumn("mad_nn", mad).drop("_all")
    share = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    more = {"cvnn": share("sdnn", "mean_nn"), "cvsd": share("rmssd", "mean_nn"), "mcv_nn": share("mad_nn", "median_nn"), "sd_rmssd": share("sdnn", "rmssd")}
    return g.withColumns(more)


#: Bands of the spectrum of intervals, in Hz.
BANDS = {"vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4), "vhf": (0.4, 0.5)}
#: Length of a template, tolerance in deviations, and lengths of the pieces that are detrended.
TEMPLATE, TOLERANCE, SCALES = 2, 0.2, (4, 6, 8, 10, 12, 16)


def whole_windows(df: DataFrame, key: list[str], position: str, value: str, width: int, stride: int, low: float, high: float) -> DataFrame:
    """key, window_index, values: every whole window that another interval follows and whose intervals lie within low and high."""
    d = df.select(*key, position, F.col(value).cast("double").alias("_v"), F.count("*").over(Window.partitionBy(*key)).alias("_n"))
    w = in_windows(d, key, position, width, stride).where(F.col("window_index") * stride + width < F.col("_n"))
    g = w.groupBy(*key, "window_index").agg(F.transform(F.array_sort(F.collect_list(F.struct(position, "_v"))), lambda p: p["_v"]).alias("values"))  # width values
    return g.where((F.array_min("values") >= low) & (F.array_max("values") <= high))


def _by_window(windows: DataFrame, key: list[str], names: list[str], run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """run(windows as rows of a matrix) -> a column a name, NaN as null; for windows of one width."""
    own = [f for f in windows.select(*key, "window_index").schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), *(f"{n} double" for n in names)])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                got = run(np.stack([np.asarray(v, float) for v in b["values"]]))
                yield pd.concat([b[[f.name for f in own]].reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

    out = windows.select(*key, "window_index", "values").mapInPandas(go, schema)
    return out.select(*key, "window_index", *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])


def lomb_scargle(t: np.ndarray, x: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """One-sided power density of values x at times t, for each row and frequency; the mean is taken out."""
    x = x - x.mean(axis=1, keepdims=True)
    out = np.empty((len(x), len(frequencies)))
    spacing = (t[:, -1] - t[:, 0]) / (t.shape[1] - 1)
    for k, f in enumerate(frequencies):
        w = 2 * np.pi * f
        turn = np.arctan2(np.sin(2 * w * t).sum(axis=1), np.cos(2 * w * t).sum(axis=1)) / 2
        c, s = np.cos(w * t - turn[:, None]), np.sin(w * t - turn[:, None])
        out[:, k] = ((x * c).sum(axis=1) ** 2 / (c * c).sum(axis=1) + (x * s).sum(axis=1) ** 2 / (s * s).sum(axis=1)) / 2
    return 2 * spacing[:, None] * out


def frequency_domain(windows: DataFrame, key: list[str], per_second: float, step: float = 0.005) -> DataFrame:
    """Power of the intervals (seconds squared) in each band, by the periodogram for irregular times.

    windows: key, window_index, values (intervals, per_second of their unit in a second). An interval stands at its end.  Also the
    total, the ratio of low to high, their shares of the total, and the logarithm of the high band; null where a divisor is 0.
    """
    grid = np.arange(1, int(round(max(b for _, b in BANDS.values()) / step)) + 1) * step
    inside = [(grid >= a - 1e-12) & (grid < b - 1e-12) for a, b in BANDS.values()]

    def run(x: np.ndarray) -> np.ndarray:
        x = x / per_second
        p = lomb_scargle(np.cumsum(x, axis=1), x, grid)
        return np.stack([p[:, i].sum(axis=1) * step for i in inside], axis=1)

    d = _by_window(windows, key, list(BANDS), run)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    d = d.withColumn("tp", sum((F.col(c) for c in list(BANDS)[1:]), F.col(list(BANDS)[0])))
    return d.withColumns({"lf_hf": share("lf", "hf"), "lf_n": share("lf", "tp"), "hf_n": share("hf", "tp"), "ln_hf": F.when(F.col("hf") > 0, F.log("hf"))})


def matches(x: np.ndarray, m: int, r: float, count: int) -> np.ndarray:
    """For each of the first count templates of m values: how many others lie within r in all places.

    Templates are sorted by their first value, and only neighbours in that order are looked at, as far as the first values allow.
    """
    t = np.lib.stride_tricks.sliding_window_view(x, m)[:count]
    order = np.argsort(t[:, 0], kind="stable")
    s, found = t[order], np.zeros(count, np.int64)
    for k in range(1, count):
        near = np.flatnonzero(s[k:, 0] - s[:-k, 0] <= r)
        if not len(near):
            break
        near = near[(np.abs(s[near + k] - s[near]) <= r).all(axis=1)]
        np.add.at(found, order[near], 1)
        np.add.at(found, order[near + k], 1)
    return found


def sample_entropy(x: np.ndarray, m: int = TEMPLATE, tolerance: float = TOLERANCE) -> float:
    """-log of the share of matching templates that match in one more value too; NaN if none do."""
    r, n = tolerance * x.std(ddof=1), len(x) - m
    a, b = matches(x, m + 1, r, n).sum(), matches(x, m, r, n).sum()
    return float(-np.log(a / b)) if a and b else np.nan


def approximate_entropy(x: np.ndarray, m: int = TEMPLATE, tolerance: float = TOLERANCE) -> float:
    r = tolerance * x.std(ddof=1)
    return float(np.subtract(*[np.log((matches(x, k, r, len(x) - k + 1) + 1) / (len(x) - k + 1)).mean() for k in (m, m + 1)]))


def fluctuation_slope(x: np.ndarray, scales: tuple[int, ...] = SCALES) -> np.ndarray:
    """Of each row: the slope of log fluctuation over log length, where pieces of the summed row are detrended by lines."""
    y = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    logs = []
    for n in scales:
        p = y[:, : y.shape[1] // n * n].reshape(len(y), -1, n)
        t = np.arange(n) - (n - 1) / 2
        left = ((p - p.mean(axis=2, keepdims=True)) ** 2).sum(axis=2) - (p @ t) ** 2 / (t @ t)
        with np.errstate(divide="ignore"):
            logs.append(np.log(np.maximum(left, 0).mean(axis=1) / n) / 2)
    f, n = np.stack(logs, axis=1), np.log(scales)
    with np.errstate(invalid="ignore"):
        return (f @ (n - n.mean())) / ((n - n.mean()) ** 2).sum()


def nonlinear(windows: DataFrame, key: list[str]) -> DataFrame:
    """Poincare deviations and what follows from them, entropies, and the short-term fluctuation slope; null where undefined."""
    names = ["sd1", "sd2", "sampen", "apen", "dfa_alpha1"]

    def run(x: np.ndarray) -> np.ndarray:
        a, b = (x[:, :-1] - x[:, 1:]) / np.sqrt(2), (x[:, :-1] + x[:, 1:]) / np.sqrt(2)
        slope = fluctuation_slope(x)
        flat = x.std(axis=1) == 0
        slope[flat | ~np.isfinite(slope)] = np.nan
        return np.stack([a.std(axis=1, ddof=1), b.std(axis=1, ddof=1), [sample_entropy(v) for v in x], [approximate_entropy(v) for v in x], slope], axis=1)

    d = _by_window(windows, key, names, run)
    share = lambda a, b: F.when(F.col("sd1") > 0, a / b)
    s1, s2 = F.col("sd1"), F.col("sd2")
    return d.withColumns({"sd_ratio": share(s1, F.when(s2 > 0, s2)), "ellipse": np.pi * s1 * s2, "csi": share(s2, s1), "cvi": F.when((s1 > 0) & (s2 > 0), F.log10(16 * s1 * s2)), "csi_modified": share(4 * s2 * s2, s1)})
