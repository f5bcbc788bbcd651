"""Sliding ranks and correlations, turnover and the gate against step-by-step versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from finlattice.operators import monitoring, risk, rolling, statistics


def ranks(x):
    return pd.Series(x).rank().to_numpy()


@pytest.mark.parametrize("n", [1, 2, 5, 20, 40])
def test_ranks_in_windows(n):
    r = np.random.default_rng(n)
    x = np.round(r.standard_normal(120), 1)
    x[r.random(120) < 0.2] = np.nan
    got = rolling.window_ranks(x, n)
    assert got.shape == (121 - n, n)
    for t in range(121 - n):
        assert np.array_equal(got[t], ranks(x[t : t + n]), equal_nan=True)
    assert rolling.window_ranks(x[:3], 5).shape == (0, 5)


def naive(x, y, n, least):
    """As stated: the finite pairs of each window."""
    out = []
    for t in range(max(len(x) - n, 0)):
        a, b = x[t : t + n], y[t : t + n]
        ok = np.isfinite(a) & np.isfinite(b)
        a, b = a[ok], b[ok]
        if len(a) < least or len(set(a)) < 2 or len(set(b)) < 2:
            out.append((np.nan, np.nan))
        else:
            out.append((np.corrcoef(a, b)[0, 1], np.corrcoef(ranks(a), ranks(b))[0, 1]))
    return np.array(out).reshape(-1, 2)


@pytest.mark.parametrize("block", [7, 4096])
def test_correlations_in_windows(monkeypatch, block):
    monkeypatch.setattr(rolling, "BLOCK", block)
    r = np.random.default_rng(3)
    x, y = np.round(r.standard_normal(200), 1), np.round(r.standard_normal(200), 2)
    x[r.random(200) < 0.3], x[50:80], y[120:150], x[10] = np.nan, 0.5, 2.0, np.inf
    want = naive(x, y, 20, 10)
    assert np.isnan(want).any() and np.isfinite(want).any()
    assert np.allclose(np.column_stack(rolling.window_correlations(x, y, 20, 10)), want, equal_nan=True)
    assert [len(v) for v in rolling.window_correlations(x[:20], y[:20], 20, 10)] == [0, 0]


def test_rolling_ic(spark):
    r = np.random.default_rng(4)
    panel = [(k, i, float(v) if r.random() > 0.2 else None, float(w), float(f) if i < 90 else None) for k in "ab" for i, (v, w, f) in enumerate(r.standard_normal((100, 3)))]
    df = spark.createDataFrame(panel, "symbol string, bar_date int, x double, z double, forward double")
    got = {row.factor: row for row in statistics.rolling_ic(statistics.long_factors(df, ["x", "z"], "forward", gaps=True)).collect()}
    for name, c in (("x", 2), ("z", 3)):
        every = np.concatenate([naive(*(np.array([np.nan if row[i] is None else row[i] for row in panel if row[0] == k and row[4] is not None]) for i in (c, 4)), 20, 10) for k in "ab"])
        mean, std = np.nanmean(every, axis=0), np.nanstd(every, axis=0, ddof=1)
        assert [got[name][f"{m}_{s}"] for m in ("ic", "rank_ic") for s in ("mean", "std", "ir")] == pytest.approx([mean[0], std[0], mean[0] / (std[0] + 1e-10), mean[1], std[1], mean[1] / (std[1] + 1e-10)])
    assert statistics.rolling_ic(statistics.long_factors(df.limit(0), ["x"], "forward", gaps=True)).count() == 0


def test_turnover_keeps_ties_and_counts_values_only(spark):
    rows = [(5.0, 5.0, 1.0, None, None), (1.0, 5.0, 5.0, 2.0, 3.0), (None,) * 5, (float("nan"), 1.0, None, 1.0, 0.0)]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "symbol string, bar_date int, a double, b double, c double, d double, e double")
    got = [r.turnover for r in statistics.factor_turnover(df, list("abcde")).orderBy("bar_date").collect()]
    assert got == pytest.approx([2 / 3, 1, 1])  # {a, b} to {b, c}; to nothing; nothing to {b, d}
    two = [r.turnover for r in statistics.factor_turnover(df, list("abcde"), rows_back=2).orderBy("bar_date").collect()]
    assert two == pytest.approx([1, 1 - 1 / 3])


def stepwise(times, hours, a_day):
    """The gate of one key, run by run."""
    let, last, day, n = [], None, None, 0
    for t in sorted(times):
        today = n if day == t.date() else 0
        if (last is None or t - last >= pd.Timedelta(hours=hours)) and today < a_day:
            let.append(t)
            last, day, n = t, t.date(), today + 1
    return let


def test_gate_step_by_step(spark):
    r = random.Random(6)
    start = pd.Timestamp("2024-01-01")
    rows = [(k, i, (start + pd.Timedelta(minutes=r.randint(0, 14400))).to_pydatetime(), "mine") for k in ("a", "b", "c", None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp, _gate string").repartition(7)
    for hours, a_day in ((4, 4), (1, 30), (7.5, 2)):
        got = monitoring.gap_allowed(df, hours=hours, a_day=a_day, key="k")
        assert got.columns == df.columns
        found = {k: sorted(x.ts for x in got.collect() if x.k == k) for k in ("a", "b", "c", None)}
        assert found == {k: stepwise([pd.Timestamp(x[2]) for x in rows if x[0] == k], hours, a_day) for k in found}
        whole = sorted(x.ts for x in monitoring.gap_allowed(df, hours=hours, a_day=a_day).collect())
        assert whole == stepwise([pd.Timestamp(x[2]) for x in rows], hours, a_day)


def test_gate_is_linear(spark):
    """One key's 200,000 runs: seconds, where an array that grows with each run took minutes."""
    runs = spark.range(200_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 14_400).alias("ts"))
    assert monitoring.gap_allowed(runs, key="k").count() == 200_000 // 6 * 4 + min(200_000 % 6, 4)  # four of the six of a day


def test_predictability(spark):
    rows = [(0.9, None), (0.9, 1.0), (0.9, 1.3), (0.4, None), (0.6, None), (0.6, 1.6), (None, 2.0), (None, None)]
    got = spark.createDataFrame(rows, "r double, e double").select(risk.predictability(F.col("r"), F.col("e")))
    assert [r[0] for r in got.collect()] == ["high", "high", "medium", "low", "medium", "low", "medium", "medium"]
