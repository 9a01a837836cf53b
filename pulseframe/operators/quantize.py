"""Vector quantisation of windows: a codebook learned by rounds of assignment and averaged updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a codebook may hold, as it is sent to all tasks.
MOST = 4_000_000


def nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row (the first of several) and the squared distance to it."""
    far = (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)[None, :]
    at = far.argmin(axis=1)
    return at, ((x - codes[at]) ** 2).sum(axis=1)


def _rows(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in values])


def learn(windows: DataFrame, initial: np.ndarray, rounds: int = 10, decay: float = 0.8, least: float = 0.0, smooth: float = 1e-5) -> np.ndarray:
    """The codebook after rounds over windows (column window, arrays of one length), from initial codes.

    In a round every task assigns its windows and sums them by code; only codes times dimensions sums come together.  A code's size and sum
    move to the round's by 1 - decay, and the code is their quotient, with sizes smoothed towards each other.  A code whose size is under
    least is put where the worst-fitted window of the round is (of several such codes each takes another one).
    """
    codes = np.array(initial, float)
    if codes.size > MOST:
        raise ValueError("the codebook is too large to be sent to all tasks")
    if not codes.size:
        return codes
    size, total = np.ones(len(codes)), codes.copy()
    for _ in range(rounds):
        now = codes

        def assign(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            n, s = np.zeros(len(now)), np.zeros(now.shape)
            worst: list[tuple[float, list[float]]] = []
            for b in batches:
                if len(b):
                    x = _rows(b["window"])
                    at, far = nearest(x, now)
                    n += np.bincount(at, minlength=len(now))
                    np.add.at(s, at, x)
                    if least > 0:
                        worst = sorted([*worst, *((float(far[i]), x[i].tolist()) for i in np.argsort(-far)[: len(now)])], reverse=True)[: len(now)]
            used = np.flatnonzero(n)
            if not len(used):
                return  # a task without rows: an empty column of arrays has no type
            yield pd.DataFrame({"code": used, "n": n[used], "sum": s[used].tolist(), "far": [None] * len(used)})
            if worst:
                yield pd.DataFrame({"code": [-1] * len(worst), "n": [0.0] * len(worst), "sum": [w for _, w in worst], "far": [f for f, _ in worst]})

        got = windows.select("window").mapInPandas(assign, "code int, n double, sum array<double>, far double")
        got = got.persist()
        sums = got.where("code >= 0").select("code", "n", F.posexplode("sum").alias("dim", "v")).groupBy("code", "dim").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # a row a code and dimension
        spare = [r["sum"] for r in got.where("code < 0").orderBy(F.desc("far")).limit(len(codes)).collect()] if least > 0 else []
        got.unpersist()
        n, s = np.zeros(len(codes)), np.zeros(codes.shape)
        for r in sums:
            n[r.code], s[r.code, r.dim] = r.n, r.v
        size, total = decay * size + (1 - decay) * n, decay * total + (1 - decay) * s
        even = (size + smooth) / (size.sum() + len(size) * smooth) * size.sum()
        codes = total / even[:, None]
        for k, place in zip(np.flatnonzero(size < least).tolist(), spare, strict=False):
            codes[k], size[k], total[k] = place, max(1.0, least), np.array(place) * max(1.0, least)
    return codes


def encode(windows: DataFrame, codes: np.ndarray) -> DataFrame:
    """windows with code and error (mean squared difference from the code); no rows where there are no codes."""
    if not codes.size:
        return windows.where("false").withColumns({"code": F.lit(0), "error": F.lit(0.0)})

    @F.pandas_udf("code int, error double")
    def run(window: pd.Series) -> pd.DataFrame:
        if not len(window):
            return pd.DataFrame({"code": np.zeros(0, np.int32), "error": np.zeros(0)})
        at, far = nearest(_rows(window), codes)
        return pd.DataFrame({"code": at.astype(np.int32), "error": far / codes.shape[1]})

    return windows.withColumn("_q", run("window")).select(*windows.columns, "_q.code", "_q.error")


def usage(encoded: DataFrame) -> DataFrame:
    """windows, codes in use, perplexity of the codes, and mean error."""
    each = encoded.groupBy("code").agg(F.count("*").alias("n"), F.sum("error").alias("e"))
    whole = each.agg(F.sum("n").alias("windows"), F.count("*").alias("used"), F.sum(F.col("n") * F.log("n")).alias("l"), F.sum("e").alias("e")).where("windows > 0")
    return whole.select("windows", "used", F.exp(F.log("windows") - F.col("l") / F.col("windows")).alias("perplexity"), (F.col("e") / F.col("windows")).alias("error"))
