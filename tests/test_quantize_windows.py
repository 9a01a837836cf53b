"""The vector quantiser against plain rounds, and the windowing table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import tables
from pulseframe.operators import quantize


def plain_rounds(x, codes, rounds, decay, smooth=1e-5):
    size, total, codes = np.ones(len(codes)), codes.copy(), codes.copy()
    for _ in range(rounds):
        at = ((x[:, None] - codes[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(len(codes)):
            size[k] = decay * size[k] + (1 - decay) * (at == k).sum()
            total[k] = decay * total[k] + (1 - decay) * x[at == k].sum(axis=0)
        whole = size.sum()
        codes = total / ((size + smooth) / (whole + len(size) * smooth) * whole)[:, None]
    return codes


def test_codebook_by_plain_rounds(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(loc=c, scale=0.1, size=(60, 6)) for c in (-2, 0, 3)])
    w = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, window array<double>").repartition(5)
    first = x[[0, 60, 61, 120]]
    codes = quantize.learn(w, first, 5, 0.7)
    assert np.allclose(codes, plain_rounds(x, first, 5, 0.7))
    got = quantize.encode(w, codes).collect()
    for r in got:
        far = ((np.array(r.window) - codes) ** 2).sum(axis=1)
        assert r.code == far.argmin() and abs(r.error - far.min() / 6) < 1e-12
    n = np.bincount([r.code for r in got], minlength=4)
    share = n[n > 0] / n.sum()
    u = quantize.usage(quantize.encode(w, codes)).first()
    assert u.windows == 180 and u.used == (n > 0).sum() and abs(u.perplexity - np.exp(-(share * np.log(share)).sum())) < 1e-9 and u.error < 0.05
    assert quantize.usage(quantize.encode(w.limit(0), codes)).count() == 0
    assert np.allclose(quantize.learn(w.limit(0), first, 1, 0.5), plain_rounds(x[:0], first, 1, 0.5))


def test_codes_that_nothing_uses_move(spark):
    x = np.concatenate([np.zeros((50, 3)), np.full((50, 3), 5.0)])
    w = spark.createDataFrame([([float(v) for v in r],) for r in x], "window array<double>")
    first = np.array([[0.0, 0, 0], [100.0, 100, 100]])
    codes = quantize.learn(w, first, 12, 0.5, least=0.6)
    assert quantize.usage(quantize.encode(w, codes)).first().error < 0.01
    with pytest.raises(ValueError):
        quantize.learn(w, np.zeros((quantize.MOST, 2)))


@pytest.mark.parametrize(("width", "stride", "tail"), [(4, 2, None), (4, 2, 1), (3, 3, 1), (2, 5, 1), (5, 1, 2), (50, 10, 1)])
def test_table_function(spark, width, stride, tail):
    series = {"a": [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0], "b": [1.0, 2.0, 3.0], "c": [None] * 6}
    tables.register(spark)
    rows = spark.createDataFrame([(k, i, v) for k, x in series.items() for i, v in enumerate(x)], "k string, i long, v double").orderBy(F.desc("i"))
    more = "" if tail is None else f", least_tail => {tail}"
    got = spark.sql(f"SELECT * FROM explode_windows(TABLE({{rows}}) PARTITION BY k ORDER BY i, key => 'k', value => 'v', width => {width}, stride => {stride}{more})", rows=rows)
    want = set()
    for k, x in series.items():
        starts = list(range(0, len(x) - width + 1, stride))
        spans = [(n, s, s + width, "full") for n, s in enumerate(starts)]
        covered = starts[-1] + width if starts else 0
        if tail is not None and starts and len(x) - covered >= tail and (len(starts) * stride <= covered):
            spans.append((len(starts), covered, len(x), "trailing"))
        for n, s, e, kind in spans:
            some = [v for v in x[s:e] if v is not None]
            want.add((k, n, s, e, kind, sum(some) / len(some) if some else None))
    assert {tuple(r) for r in got.collect()} == want


def test_codebook_with_tasks_without_rows(spark):
    """Splits of a file may hold no rows; nor may the whole table, or the first codes."""
    x = np.random.default_rng(6).normal(size=(3, 4))
    w = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, window array<double>").repartition(8)
    assert np.allclose(quantize.learn(w, x[:2], 2), plain_rounds(x, x[:2], 2, 0.8))
    none = w.where("i < 0")
    assert np.allclose(quantize.learn(none, x[:2], 2), plain_rounds(x[:0], x[:2], 2, 0.8))
    assert quantize.encode(w, quantize.learn(w, np.array([]), 2)).count() == 0
