"""Spectral and nonlinear indices of intervals against their definitions."""

import math

import numpy as np
import pytest

from pulseframe.operators import hrv


def plain_entropies(x, m=2, tolerance=0.2):
    r, n = tolerance * x.std(ddof=1), len(x)
    near = lambda i, j, k: max(abs(x[i + t] - x[j + t]) for t in range(k)) <= r
    a = sum(near(i, j, m + 1) for i in range(n - m) for j in range(n - m) if i != j)
    b = sum(near(i, j, m) for i in range(n - m) for j in range(n - m) if i != j)
    phi = [np.mean([math.log(sum(near(i, j, k) for j in range(n - k + 1)) / (n - k + 1)) for i in range(n - k + 1)]) for k in (m, m + 1)]
    return (-math.log(a / b) if a and b else math.nan), phi[0] - phi[1]


@pytest.mark.parametrize("seed", range(5))
def test_entropies(seed):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=40), np.sin(np.arange(60) / 3), rng.integers(0, 3, 50).astype(float), np.repeat([1.0, 2.0], 15), rng.normal(size=8)][seed]
    want = plain_entropies(x)
    got = hrv.sample_entropy(x), hrv.approximate_entropy(x)
    for g, w in zip(got, want, strict=True):
        assert (math.isnan(g) and math.isnan(w)) or abs(g - w) < 1e-12


def test_power_of_known_oscillations():
    """A slow and a fast oscillation show in their bands with half their squared amplitudes, on even and uneven times."""
    grid = np.arange(1, 100) * 0.005
    for jitter in (0.0, 0.05):
        t = np.arange(800) * 1.0 + np.random.default_rng(1).uniform(-jitter, jitter, 800)
        x = 0.3 * np.sin(2 * np.pi * 0.1 * t + 1) + 0.1 * np.cos(2 * np.pi * 0.25 * t)
        p = hrv.lomb_scargle(t[None], x[None], np.arange(1, 4000) * 0.000125)[0]
        f = np.arange(1, 4000) * 0.000125
        for low, high, amplitude in ((0.04, 0.15, 0.3), (0.15, 0.4, 0.1)):
            assert abs(p[(f >= low) & (f < high)].sum() * 0.000125 - amplitude**2 / 2) < 0.1 * amplitude**2
        assert grid[hrv.lomb_scargle(t[None], x[None], grid)[0].argmax()] == pytest.approx(0.1)


def test_fluctuation_slopes():
    """About 0.5 for noise and 1.5 for its sums; by lines fitted to each piece."""
    rng = np.random.default_rng(2)
    noise = rng.normal(size=(200, 400))
    assert abs(hrv.fluctuation_slope(noise).mean() - 0.5) < 0.12 and abs(hrv.fluctuation_slope(np.cumsum(noise, axis=1)).mean() - 1.5) < 0.12
    x = noise[0]
    y, logs = np.cumsum(x - x.mean()), []
    for n in hrv.SCALES:
        left = [np.sum((p - np.polyval(np.polyfit(np.arange(n), p, 1), np.arange(n))) ** 2) for p in y[: 400 // n * n].reshape(-1, n)]
        logs.append(math.log(math.sqrt(np.mean(left) / n)))
    assert abs(hrv.fluctuation_slope(noise[:1])[0] - np.polyfit(np.log(hrv.SCALES), logs, 1)[0]) < 1e-9


def test_windows_without_variation_have_nulls(spark):
    d = spark.createDataFrame([("a", i, 80.0) for i in range(41)] + [("b", i, 80.0 + i % 7) for i in range(41)] + [("c", i, 400.0) for i in range(41)] + [("d", 0, 80.0)], "k string, i long, v double")
    w = hrv.whole_windows(d, ["k"], "i", "v", 40, 20, 1.0, 250.0)
    flat, moves = hrv.nonlinear(w, ["k"]).orderBy("k").collect()
    assert flat.k == "a" and flat.sd1 == 0 and flat.dfa_alpha1 is None and flat.csi is None and flat.cvi is None and moves.sd1 > 0 and moves.sampen is not None
    flat, moves = hrv.frequency_domain(w, ["k"], 100.0).orderBy("k").collect()
    assert flat.tp < 1e-20 and moves.tp > 0 and abs(moves.lf_n * moves.tp - moves.lf) < 1e-12
