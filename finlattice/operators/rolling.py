"""Order statistics in sliding windows: ranks kept up to date as values come and go."""

from __future__ import annotations

import numpy as np

#: Window rows that are compared at a time.
BLOCK = 4096


def window_ranks(x: np.ndarray, n: int) -> np.ndarray:
    """[t, j]: the rank, counted from 1 with ties sharing their mean, of x[t + j] among x[t : t + n].

    NaN takes no part.  A value's rank changes by its comparison with the value that leaves and with the
    one that comes: with all comparisons of values less than n apart summed up along the distance,
    the rank in each of its n windows is a difference of two sums.  Work and memory grow with n, not its square.
    """
    size = len(x)
    if size < n:
        return np.zeros((0, n))
    padded = np.concatenate([np.full(n - 1, np.nan), x, np.full(n - 1, np.nan)])
    near = np.lib.stride_tricks.sliding_window_view(padded, 2 * n - 1)  # [s, d]: x[s + d - n + 1]
    below = (near < x[:, None]) + 0.5 * (near == x[:, None])
    sums = np.concatenate([np.zeros((size, 1)), np.cumsum(below, axis=1)], axis=1)
    # as the j-th of its window, x[s] is compared with those from j before it to n - 1 - j after
    of_place = np.stack([sums[:, 2 * n - 1 - j] - sums[:, n - 1 - j] for j in range(n)], axis=1) + 0.5
    windows = np.arange(size - n + 1)
    ranks = of_place[windows[:, None] + np.arange(n), np.arange(n)]
    return np.where(np.isnan(np.lib.stride_tricks.sliding_window_view(x, n)), np.nan, ranks)


def _correlations(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Of each row's pairs without NaN; NaN below `least` pairs or without spread."""
    ok = ~(np.isnan(a) | np.isnan(b))
    count = ok.sum(axis=1)
    sides = []
    for x in (a, b):
        x = np.where(ok, x, 0.0)
        x = np.where(ok, x - (x.sum(axis=1) / np.maximum(count, 1))[:, None], 0.0)
        sides.append((x, (x**2).sum(axis=1)))
    (x, sx), (y, sy) = sides
    flat = [np.where(ok, v, np.inf).min(axis=1) == np.where(ok, v, -np.inf).max(axis=1) for v in (a, b)]
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (x * y).sum(axis=1) / np.sqrt(sx * sy)
    return np.where((count >= least) & ~flat[0] & ~flat[1], r, np.nan)


def window_correlations(x: np.ndarray, y: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pearson's and Spearman's correlation of the finite pairs in each n consecutive rows but the last n."""
    x = np.where(np.isfinite(x) & np.isfinite(y), x, np.nan)
    y = np.where(np.isnan(x), np.nan, y)
    count = max(len(x) - n, 0)
    plain, ranked = np.empty(count), np.empty(count)
    for a in range(0, count, BLOCK):
        b = min(a + BLOCK, count)
        xs, ys = x[a : b + n - 1], y[a : b + n - 1]
        plain[a:b] = _correlations(*(np.lib.stride_tricks.sliding_window_view(v, n) for v in (xs, ys)), least)
        ranked[a:b] = _correlations(window_ranks(xs, n), window_ranks(ys, n), least)
    return plain, ranked
