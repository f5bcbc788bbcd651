"""Kernels against closed forms and plain restatements."""

import math

import numpy as np
import pandas as pd
import pytest

from finlattice.operators import kernels as k
from finlattice.operators import recurrence as rec

random = np.random.default_rng(42)
WALK = 100 + np.cumsum(random.standard_normal(300))


def test_welch_finds_a_sine():
    x = np.sin(2 * np.pi * np.arange(512) / 16) + 0.1 * random.standard_normal(512)
    assert k.dominant_periods(*k.welch(x), top=1)[0][1] == pytest.approx(16, rel=0.05)
    assert k.dominant_periods(*k.fft_spectrum(x), top=1)[0][1] == pytest.approx(16, rel=0.05)


def test_welch_power_is_the_variance():
    x = random.standard_normal(4096)
    f, p = k.welch(x)
    assert p.sum() * (f[1] - f[0]) == pytest.approx(1, rel=0.1)


def test_stl_adds_up_and_finds_the_season():
    season = np.tile([0.0, 3, -1, 2, -4], 40)
    trend, found, rest = k.stl(np.arange(200) * 0.1 + season, 5)
    assert np.allclose(trend + found + rest, np.arange(200) * 0.1 + season)
    assert np.abs(found[20:-20] - season[20:-20]).max() < 0.5
    assert k.stl(np.arange(13.0)) is None


def test_dtw():
    a = np.array([1.0, 2, 3, 4])
    assert k.dtw(a, a) == (0.0, 4)
    assert k.dtw(a, np.array([1.0, 1, 2, 3, 4]))[0] == 0.0
    assert k.dtw(a, np.arange(10.0), band=2)[0] == math.inf
    b = random.standard_normal(12)
    cost = np.full((5, 13), np.inf)
    cost[0, 0] = 0
    for i in range(1, 5):
        for j in range(1, 13):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    assert k.dtw(a, b)[0] == pytest.approx(cost[4, 12])


def test_similar_patterns_finds_itself():
    assert k.similar_patterns(WALK[50:70], WALK)[0][1:] == (50, 0.0)


def test_sample_entropy_by_pairs():
    x, r = random.standard_normal(80), 0.5
    def count(m, n):
        t = [x[i : i + m] for i in range(n)]
        return sum(np.abs(p - q).max() < r for i, p in enumerate(t) for j, q in enumerate(t) if i != j)
    assert k.sample_entropy(x, 2, r) == pytest.approx(-math.log(count(3, 77) / count(2, 78)))
    assert k.sample_entropy(np.zeros(50)) == math.inf
    assert k.approximate_entropy(np.tile([1.0, 2], 50)) == pytest.approx(0, abs=0.02)


def test_normalised_flat_series():
    flat = np.full(5, 2.0)
    assert (k.normalised(flat) == 0).all() and (k.normalised(flat, "minmax") == 0.5).all() and (k.normalised(flat, "first") == 1).all()
    with pytest.raises(ValueError):
        k.normalised(flat, "other")


def test_ema_and_rsi():
    e = [WALK[0]]
    for x in WALK[1:]:
        e.append(e[-1] + (x - e[-1]) * 2 / 13)
    assert np.allclose(rec.ema(WALK, rec.span(12)), e)
    assert np.isnan(rec.rsi(np.arange(30.0))).all()
    line, signal, hist = rec.macd(WALK)
    assert np.allclose(line - signal, hist)
    assert pd.Series(rec.rsi(WALK)).dropna().between(0, 100).all()


def test_dtw_by_diagonals_is_the_path():
    r = np.random.default_rng(8)
    for n, m, band in ((1, 1, None), (5, 9, None), (9, 5, None), (30, 30, None), (17, 23, 8), (17, 23, 3), (20, 20, 0), (1, 7, None)):
        for digits in (0, 1, 6):  # few digits: many ties
            a, b = np.round(r.standard_normal(n), digits), np.round(r.standard_normal(m), digits)
            distance, path = k.dtw_path(a, b, band)
            assert k.dtw(a, b, band) == (distance, len(path))
            if distance < math.inf:
                assert k.dtw(a, b, band, most=distance) == (distance, len(path)) and k.dtw(a, b, band, most=distance - 0.01) == (math.inf, 0)
    assert k.dtw(np.zeros(0), np.zeros(3)) == (math.inf, 0)


def test_patterns_by_trying_every_window():
    r = np.random.default_rng(9)
    series = np.cumsum(r.standard_normal(300))
    series[40:60], series[100:120] = series[-20:], 1.0
    for target in (series[-20:], np.ones(20), np.arange(20.0)):
        t = k.normalised(target)
        every = sorted((k.dtw(t, k.normalised(series[i : i + 20]))[0], i) for i in range(0, 281, 3))
        got = k.similar_patterns(target, series, top=7, step=3)
        assert [(d, i) for _, i, d in got] == every[:7] and [x[0] for x in got] == list(range(1, 8))
        windows = np.array([k.normalised(series[i : i + 20]) for i in range(281)])
        assert (k.least_distances(t, windows) <= [k.dtw(t, w)[0] for w in windows]).all()
    assert k.similar_patterns(np.ones(5), np.ones(3)) == []
