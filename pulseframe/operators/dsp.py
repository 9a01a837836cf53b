"""Filters, spectra and peak detection on arrays, as numpy kernels, and the operators that apply them to each series."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import _each


@lru_cache(maxsize=64)
def butter_sections(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Band-pass Butterworth as second-order sections (b0 b1 b2 1 a1 a2), by the bilinear transform of the analog poles."""
    high = min(high, 0.99 * fs / 2)
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    w1, w2 = warp(low), warp(high)
    band, centre = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * band / 2
    root = np.sqrt(half**2 - centre**2)
    return _sections(np.concatenate([half + root, half - root]), order, fs, centre)


@lru_cache(maxsize=64)
def cheby_sections(order: int, ripple: float, cut: float) -> np.ndarray:
    """Low-pass Chebyshev type I as sections; cut is a share of the Nyquist frequency."""
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    warped = 4 * np.tan(np.pi * cut / 2)
    poles = warped * (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta))
    gain = 1 / np.sqrt(1 + eps**2) if order % 2 == 0 else 1.0
    z = (4 + poles) / (4 - poles)
    out = []
    for p in z[z.imag > 1e-14]:
        a = np.array([1, -2 * p.real, abs(p) ** 2])
        out.append(np.concatenate([np.array([1, 2, 1]) * a.sum() / 4, a]))
    for p in z[np.abs(z.imag) <= 1e-14]:
        out.append(np.concatenate([np.array([1, 1, 0]) * (1 - p.real) / 2, [1, -p.real, 0]]))
    sos = np.array(out)
    sos[0, :3] *= gain
    return sos


def _sections(poles: np.ndarray, order: int, fs: float, centre: float) -> np.ndarray:
    z = (2 * fs + poles) / (2 * fs - poles)
    pairs = z[z.imag > 1e-14]
    real = np.sort(z[np.abs(z.imag) <= 1e-14].real)
    a = [np.array([1, -2 * p.real, abs(p) ** 2]) for p in pairs] + [np.array([1, -(x + y), x * y]) for x, y in zip(real[::2], real[1::2], strict=True)]
    w = np.exp(1j * 2 * np.arctan(centre / (2 * fs)))
    out = []
    for s in a:  # each with zeros at 1 and -1, and a gain of 1 at the centre
        b = np.array([1.0, 0.0, -1.0])
        out.append(np.concatenate([b / abs(np.polyval(b, w) / np.polyval(s, w)), s]))
    return np.array(out)


@lru_cache(maxsize=256)
def _blocked(section: tuple[float, ...], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a section: outputs of a block's inputs, outputs of the states before it, what inputs leave in the states, and what states become."""
    b0, b1, b2, _, a1, a2 = section
    step, gain = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    free = np.array([p[0] for p in powers[:block]])
    response = np.concatenate(([b0], free[:-1] @ gain))
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    forced = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    into = np.array([powers[block - 1 - k] @ gain for k in range(block)])
    return forced, free, into, powers[block]


def run_sections(sos: np.ndarray, x: np.ndarray, start: bool = True, block: int = 64) -> np.ndarray:
    """The filter's output, from the state of a constant input of the first value if start.

    A section is a system with two states.  In a block the output is a triangular product with its impulse response,
    and only the states are carried from block to block one after the other.  What a section does to a block is worked out once.
    """
    y = np.asarray(x, float)
    level = y[0] if start and len(y) else 0.0
    for section in sos.tolist():
        b0, b1, b2, _, a1, a2 = section
        forced, free, into, after = _blocked(tuple(section), block)
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = (b2 - a2 * dc) * level
        state = np.array([(b1 - a1 * dc) * level + s2, s2])
        n = -(-len(y) // block)
        rows = np.zeros((n, block))
        rows.ravel()[: len(y)] = y
        left, states = rows @ into, np.empty((n, 2))
        for k in range(n):
            states[k] = state
            state = after @ state + left[k]
        y, level = (rows @ forced.T + states @ free.T).ravel()[: len(y)], level * dc
    return y


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward, with the ends mirrored through their points."""
    x = np.asarray(x, float)
    pad = min(pad, len(x) - 1)
    if pad < 1:
        return x.copy()
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = run_sections(sos, run_sections(sos, ext)[::-1])[::-1]
    return y[pad:-pad]


def bandpass(x: np.ndarray, fs: float, low: float = 0.5, high: float = 40.0, order: int = 4) -> np.ndarray:
    return zero_phase(butter_sections(order, low, high, fs), x, 3 * (2 * order + 1))


def decimate(x: np.ndarray, fs: int, target: int) -> tuple[np.ndarray, float]:
    """About target samples a second, by a whole factor behind an order-8 filter, or by Fourier below a factor of 2; and
    the true new rate."""
    if target >= fs:
        return np.asarray(x, float), float(fs)
    factor = fs // target
    if factor < 2:
        n = int(len(x) * target / fs)
        f = np.fft.rfft(x)[: n // 2 + 1]
        return np.fft.irfft(f, n) * n / len(x), float(target)
    return zero_phase(cheby_sections(8, 0.05, 0.8 / factor), x, 27)[::factor], fs / factor


def band_power(x: np.ndarray, fs: float, bands: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Mean power density of the Hann-windowed values in each band [low, high), and of all."""
    n = len(x)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))
    p = np.abs(np.fft.rfft(x * w)) ** 2 / (fs * (w**2).sum())
    f = np.fft.rfftfreq(n, 1 / fs)
    out = {k: float(p[(f >= a) & (f < b)].mean()) if ((f >= a) & (f < b)).any() else 0.0 for k, (a, b) in bands.items()}
    return out | {"total": float(p.sum())}


#: Hertz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Beats of an electrocardiogram by two moving averages of the squared 8 to 20 Hz band.

    Blocks where the short average (0.12 s) is over the long one (0.65 s) plus 0.08 of the mean, at least as wide as the
    short window; a beat is the largest value of a block; of beats within 250 ms the larger stays.
    """
    y = zero_phase(butter_sections(3, 8.0, 20.0, fs), x, 21) ** 2
    mean = lambda k: np.convolve(y, np.ones(k) / k, "same")
    w1, w2 = max(1, int(0.12 * fs)), max(1, int(0.65 * fs))
    on = np.concatenate(([0], (mean(w1) > mean(w2) + 0.08 * y.mean()).astype(int), [0]))
    edge = np.flatnonzero(np.diff(on))
    beats: list[int] = []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a < w1:
            continue
        p = a + int(np.argmax(x[a:b]))
        if beats and p - beats[-1] < 0.25 * fs:
            if x[p] > x[beats[-1]]:
                beats[-1] = p
        else:
            beats.append(p)
    return np.array(beats, np.int64)


def simple_peaks(x: np.ndarray, distance: int, height: float = 0.3, prominence: float = 0.0) -> np.ndarray:
    """Local maxima over height deviations, by falling value at least distance apart, with a prominence."""
    x = np.asarray(x, float)
    top = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    top = top[x[top] >= height * x.std()]
    keep = np.ones(len(top), bool)
    for i in np.argsort(-x[top], kind="stable"):
        if keep[i]:
            near = np.abs(top - top[i]) < distance
            near[i] = False
            keep &= ~near
    top = top[keep]
    if prominence <= 0:
        return top
    out = []
    for p in top:
        higher = np.flatnonzero(x > x[p])
        a = higher[higher < p].max(initial=-1) + 1
        b = higher[higher > p].min(initial=len(x))
        if x[p] - max(x[a : p + 1].min(), x[p:b].min()) >= prominence:
            out.append(p)
    return np.array(out, np.int64)


def filtered(df: DataFrame, key: list[str], fs: float, low: float, high: float, order: int = 4) -> DataFrame:
    """key, pos, v: every series (values) through the band-pass."""

    def run(x: np.ndarray) -> dict:
        y = bandpass(x, fs, low, high, order) if len(x) > 1 else x
        return {"pos": np.arange(len(y)), "v": y}

    return _each(df, key, "pos long, v double", run)


def decimated(df: DataFrame, key: list[str], fs: int, target: int) -> DataFrame:
    """key, pos, v, fs_true: every series at about target samples a second."""

    def run(x: np.ndarray) -> dict:
        y, rate = decimate(x, fs, target)
        return {"pos": np.arange(len(y)), "v": y, "fs_true": np.full(len(y), rate)}

    return _each(df, key, "pos long, v double, fs_true double", run)


def powers(df: DataFrame, key: list[str], fs: float, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """key and a power for each band and in total."""
    named = bands or BANDS

    def run(x: np.ndarray) -> dict:
        return {k: [v] for k, v in band_power(x, fs, named).items()}

    return _each(df, key, ", ".join(f"`{k}` double" for k in [*named, "total"]), run)


def beats(df: DataFrame, key: list[str], fs: float) -> DataFrame:
    """key, beat_idx, pos, rr (milliseconds since the beat before, null for the first)."""

    def run(x: np.ndarray) -> dict:
        p = r_peaks(x, fs)
        rr = [None, *(np.diff(p) * 1000.0 / fs).tolist()][: len(p)]
        return {"beat_idx": np.arange(len(p)), "pos": p, "rr": pd.array(rr, "Float64")}

    return _each(df, key, "beat_idx long, pos long, rr double", run)


def time_features(values: Column) -> dict[str, Column]:
    """Features of an array in the time domain, as columns that stay in the JVM."""
    n = F.size(values).cast("double")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = add(values) / n
    power = add(F.transform(values, lambda x: x * x)) / n
    steps = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return {"std": F.sqrt(F.greatest(power - mean * mean, F.lit(0.0))), "low": F.array_min(values), "high": F.array_max(values), "line_length": add(steps), "rms": F.sqrt(power)}


def peaks(df: DataFrame, key: list[str], distance: int, height: float = 0.3, prominence: float = 0.0) -> DataFrame:
    """key, pos: simple_peaks of each series' values."""
    return _each(df, key, "pos long", lambda x: {"pos": simple_peaks(x, distance, height, prominence)})


def upsampled(values: Column, n: int, to: int) -> Column:
    """An array of n values stretched linearly to another length; values stand in the middle of their stretches."""

    def at(i: Column) -> Column:
        s = F.greatest(F.lit(0.0), (i + 0.5) * (n / to) - 0.5)
        low = F.floor(s).cast("int")
        part = s - low
        return F.element_at(values, low + 1) * (1 - part) + F.element_at(values, F.least(F.lit(n - 1), low + 1) + 1) * part

    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), at)


def stft(x: np.ndarray, n_fft: int) -> np.ndarray:
    """Normalised Fourier transforms (bins, frames) of periodic Hann windows every quarter of n_fft; the ends are mirrored."""
    half, hop = n_fft // 2, max(1, n_fft // 4)
    padded = np.concatenate([x[half:0:-1], x, x[-2 : -half - 2 : -1]])
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.fft.rfft(frames * window, axis=1).T / np.sqrt(n_fft)


def istft(z: np.ndarray, n_fft: int) -> np.ndarray:
    """The values that stft() came from (as far as whole frames reach), by overlap-add over the squared windows."""
    half, hop, n = n_fft // 2, max(1, n_fft // 4), z.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    total, weight = np.zeros(n_fft + hop * (n - 1)), np.zeros(n_fft + hop * (n - 1))
    for k, frame in enumerate(np.fft.irfft(z.T * np.sqrt(n_fft), n_fft, axis=1)):
        total[k * hop : k * hop + n_fft] += frame * window
        weight[k * hop : k * hop + n_fft] += window * window
    return (total / np.where(weight > 1e-11, weight, 1.0))[half:-half]


def spectrogram(df: DataFrame, key: list[str], n_fft: int) -> DataFrame:
    """key, frame, bin, re, im: stft() of each series longer than half a window."""

    def run(x: np.ndarray) -> dict:
        z = stft(x, n_fft)
        frame, bin_ = np.meshgrid(np.arange(z.shape[1]), np.arange(z.shape[0]))
        return {"frame": frame.ravel(), "bin": bin_.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()}

    return _each(df.where(F.size("values") > n_fft // 2 + 1), key, "frame int, bin int, re double, im double", run)
