"""Numeric kernels over one whole series: spectra, decomposition, warping, entropy.

by_key() runs a kernel for each key in Arrow batches; a key's series is one instrument's history,
sorted by date inside its group.  Kernels are plain numpy functions and are tested as such.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_key(df: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str, value: str, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """(key, schema): the rows that the kernel gives for each key's values in date order, nulls left out."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(date)[value].dropna().to_numpy(float)
        out = pd.DataFrame(kernel(x), columns=names)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return df.select(key, date, value).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


# Spectra


def welch(x: np.ndarray, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Power density: Hann windows with half overlap, each segment detrended by a line."""
    n = min(max(min(len(x) // 4, 256), 8), len(x))
    if n < 2:
        return np.zeros(0), np.zeros(0)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    pieces = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    t = np.arange(n) - (n - 1) / 2
    flat = pieces - pieces.mean(axis=1, keepdims=True) - (pieces @ t / (t @ t))[:, None] * t
    power = np.abs(np.fft.rfft(flat * taper, axis=1)) ** 2 / (rate * (taper**2).sum())
    power[:, 1 : (None if n % 2 else -1)] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power.mean(axis=0)


def fft_spectrum(x: np.ndarray, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Amplitudes of the positive frequencies of the demeaned series under a Hann window."""
    n = len(x)
    amplitude = 2 / n * np.abs(np.fft.fft((x - x.mean()) * np.hanning(n)))
    f = np.fft.fftfreq(n, 1 / rate)
    return f[f > 0], amplitude[f > 0]


def dominant_periods(f: np.ndarray, power: np.ndarray, top: int = 3, least: float = 2.0) -> list[tuple]:
    """(rank, period, power, share) of the strongest frequencies with a period of at least `least`."""
    ok = f > 0
    f, power = f[ok], power[ok]
    ok = 1 / f >= least
    f, power = f[ok], power[ok]
    total = power.sum() or 1.0
    return [(r, float(1 / f[i]), float(power[i]), float(power[i] / total)) for r, i in enumerate(np.argsort(-power, kind="stable")[:top], 1)]


def morlet(x: np.ndarray, scales: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scales and coefficients (scale x time) of the real Morlet wavelet exp(-t^2/2) cos(5 t)."""
    scales = np.arange(2, max(3, min(100, len(x) // 2))) if scales is None else scales
    x = x - x.mean()
    out = np.empty((len(scales), len(x)))
    for i, s in enumerate(scales):
        t = np.arange(-4 * s, 4 * s + 1) / s
        wave = np.exp(-(t**2) / 2) * np.cos(5 * t) / math.sqrt(s)
        full = np.convolve(x, wave[::-1])
        out[i] = full[4 * s : 4 * s + len(x)]
    return scales, out


# Decomposition and tests


def _loess(y: np.ndarray, width: int, weights: np.ndarray) -> np.ndarray:
    """Local lines through the `width` values around each value; all windows at once."""
    n, half = len(y), min(width, len(y)) // 2
    first = np.clip(np.arange(n) - half, 0, max(0, n - width))
    size = min(width, n)
    t = first[:, None] + np.arange(size) - np.arange(n)[:, None]
    near = np.lib.stride_tricks.sliding_window_view(y, size)[first]
    d = np.abs(t) / (np.abs(t).max(axis=1, keepdims=True) + 1)
    w = (1 - d**3) ** 3 * np.lib.stride_tricks.sliding_window_view(weights, size)[first]
    sw = w.sum(axis=1)
    some = np.where(sw > 0, sw, 1.0)
    mt, my = (w * t).sum(axis=1) / some, (w * near).sum(axis=1) / some
    off = t - mt[:, None]
    var = (w * off**2).sum(axis=1)
    slope = np.where(var > 1e-12, (w * off * (near - my[:, None])).sum(axis=1) / np.where(var > 1e-12, var, 1.0), 0.0)
    return np.where(sw > 0, my - slope * mt, y)


def stl(x: np.ndarray, period: int | None = None, inner: int = 2, outer: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Trend, season and remainder, robust to outliers; None for fewer than 14 values."""
    n = len(x)
    period = max(2, min(5, n // 4)) if period is None else period
    if n < 14:
        return None
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    width = int(math.ceil(1.5 * period / (1 - 1.5 / 7))) | 1
    for _ in range(outer):
        for _ in range(inner):
            rest = x - trend
            season = np.empty(n)
            for p in range(period):
                season[p::period] = _loess(rest[p::period], 7, weights[p::period])
            season -= _loess(np.convolve(np.pad(season, period, mode="edge"), np.ones(period) / period, "same")[period:-period], width, np.ones(n))
            trend = _loess(x - season, width, weights)
        left = np.abs(x - trend - season)
        h = 6 * np.median(left)
        weights = (1 - np.clip(left / h, 0, 1) ** 2) ** 2 if h > 0 else np.ones(n)
    return trend, season, x - trend - season


# Warping


def normalised(x: np.ndarray, how: str = "zscore") -> np.ndarray:
    if how == "zscore":
        s = x.std()
        return (x - x.mean()) / s if s else x - x.mean()
    if how == "minmax":
        spread = x.max() - x.min()
        return (x - x.min()) / spread if spread else np.full(len(x), 0.5)
    if how == "first":
        return x / x[0] if x[0] else x
    raise ValueError(f"unknown method {how!r}")


def warping_costs(a: np.ndarray, b: np.ndarray, band: int | None = None) -> np.ndarray:
    """The cost of the best path to each pair of places, counted from 1; infinite beyond the band."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    flat, back = cost.reshape(-1), b[::-1]
    for s in range(2, n + m + 1):  # the cells with i + j = s lie m apart in flat and need only those of s - 1 and s - 2
        low, high = max(1, s - m), min(n, s - 1)
        if band is not None:
            low, high = max(low, (s - band + 1) // 2), min(high, (s + band) // 2)
        if low > high:
            continue
        x, k = low * m, (high - low) * m + 1
        before = np.minimum(np.minimum(flat[s - 2 - m + x :][:k:m], flat[s - 1 - m + x :][:k:m]), flat[s - 1 + x :][:k:m])
        flat[s + x :][:k:m] = np.abs(a[low - 1 : high] - back[m - s + low : m - s + high + 1]) + before
    return cost


def dtw_path(a: np.ndarray, b: np.ndarray, band: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Distance and pairs of places from 0 on (ties: diagonal, then up, then left); infinite and empty if the band can't reach the corner."""
    cost = warping_costs(a, b, band)
    i, j = len(a), len(b)
    if not np.isfinite(cost[i, j]) or not i or not j:
        return math.inf, []
    path = [(i - 1, j - 1)]
    while (i, j) != (1, 1):
        _, _, i, j = min((cost[i - 1, j - 1], 0, i - 1, j - 1), (cost[i - 1, j], 1, i - 1, j), (cost[i, j - 1], 2, i, j - 1))
        path.append((i - 1, j - 1))
    return float(cost[len(a), len(b)]), path[::-1]


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None, most: float = math.inf) -> tuple[float, int]:
    """Distance and path length, as dtw_path() has them, from two anti-diagonals at a time; infinite and 0 beyond `most`."""
    n, m = len(a), len(b)
    if not n or not m:
        return math.inf, 0
    back, ahead = b[::-1], np.full(n + 1, np.inf)
    two, one = ahead.copy(), ahead.copy()  # the costs of the diagonals s - 2 and s - 1, by place in a
    two[0] = 0
    two_steps, one_steps = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for s in range(2, n + m + 1):
        low, high = max(1, s - m), min(n, s - 1)
        if band is not None:
            low, high = max(low, (s - band + 1) // 2), min(high, (s + band) // 2)
        now, steps = ahead.copy(), np.zeros(n + 1, np.int64)
        if low <= high:
            diagonal, up, left = two[low - 1 : high], one[low - 1 : high], one[low : high + 1]
            straight, above = (diagonal <= up) & (diagonal <= left), up <= left
            now[low : high + 1] = np.abs(a[low - 1 : high] - back[m - s + low : m - s + high + 1]) + np.minimum(np.minimum(diagonal, up), left)
            steps[low : high + 1] = 1 + np.where(straight, two_steps[low - 1 : high], np.where(above, one_steps[low - 1 : high], one_steps[low : high + 1]))
        if most < math.inf and s % 8 == 0 and min(now.min(), one.min()) > most:
            return math.inf, 0  # each path passes one of two diagonals in a row
        two, one, two_steps, one_steps = one, now, one_steps, steps
    return (float(one[n]), int(one_steps[n])) if np.isfinite(one[n]) and one[n] <= most else (math.inf, 0)


def least_distances(target: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A lower bound of the distance of each window: what lies beyond the other's range has to be bridged, and the ends meet."""
    low, high = windows.min(axis=1, keepdims=True), windows.max(axis=1, keepdims=True)
    own = (np.maximum(target - high, 0) + np.maximum(low - target, 0)).sum(axis=1)
    other = (np.maximum(windows - target.max(), 0) + np.maximum(target.min() - windows, 0)).sum(axis=1)
    ends = np.abs(windows[:, 0] - target[0]) + (np.abs(windows[:, -1] - target[-1]) if windows.shape[1] > 1 else 0)
    return np.maximum(np.maximum(own, other), ends) * (1 - 1e-12)


def similar_patterns(target: np.ndarray, series: np.ndarray, top: int = 5, step: int = 1) -> list[tuple]:
    """(rank, begin, distance) of the windows of a series that warp best onto the target.

    Windows are tried from the least lower bound up, and given up where they exceed the worst of the best.
    """
    length, t = len(target), normalised(target)
    begins = np.arange(0, len(series) - length + 1, step)
    if not begins.size:
        return []
    windows = np.array([normalised(series[i : i + length]) for i in begins.tolist()])
    bounds = least_distances(t, windows)
    found: list[tuple[float, int]] = []
    for k in np.argsort(bounds, kind="stable").tolist():
        most = found[top - 1][0] if len(found) >= top else math.inf
        if bounds[k] > most:
            break
        distance, _ = dtw(t, windows[k], most=most)
        if distance < math.inf:
            found = sorted([*found, (distance, int(begins[k]))])[:top]
    return [(r, i, d) for r, (d, i) in enumerate(found, 1)]


def similarity_level(distance: float) -> str:
    return next((name for most, name in ((0.1, "very high"), (0.3, "high"), (0.5, "medium"), (0.8, "low")) if distance < most), "very low")


# Complexity


def _matches(x: np.ndarray, m: int, r: float, strict: bool, count: int) -> np.ndarray:
    """For each of `count` templates of length m, how many templates are within r (itself included), in blocks."""
    t = np.lib.stride_tricks.sliding_window_view(x, m)[:count]
    out = np.zeros(count, np.int64)
    for a in range(0, count, 256):
        gap = np.abs(t[a : a + 256, None, :] - t[None]).max(axis=2)
        out[a : a + 256] = ((gap < r) if strict else (gap <= r)).sum(axis=1)
    return out


def sample_entropy(x: np.ndarray, m: int = 2, r: float | None = None) -> float:
    """-ln(A / B); tolerance 0.2 population deviations; infinite where A or B is 0."""
    n = len(x)
    r = 0.2 * x.std() if r is None else r
    if n <= m + 1:
        return math.nan
    b = int((_matches(x, m, r, True, n - m) - (r > 0)).sum())
    a = int((_matches(x, m + 1, r, True, n - m - 1) - (r > 0)).sum())
    return math.inf if a <= 0 or b <= 0 else -math.log(a / b)


def approximate_entropy(x: np.ndarray, m: int = 2, r: float | None = None) -> float:
    r = 0.2 * x.std() if r is None else r

    def phi(k: int) -> float:
        count = len(x) - k + 1
        return float(np.log(_matches(x, k, r, False, count) / count).mean())

    return phi(m) - phi(m + 1) if len(x) > m + 1 else math.nan
