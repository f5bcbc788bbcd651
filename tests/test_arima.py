"""Exact likelihoods against dense covariances and closed forms; Dickey-Fuller against published values."""

import math

import numpy as np
import pytest

from finlattice.operators import arima

random = np.random.default_rng(11)
NOISE = random.standard_normal(4000)
WALK = np.cumsum(NOISE[:400]) + 50


def process(phi, theta, n, seed=1):
    e, x = np.random.default_rng(seed).standard_normal(n + 200), np.zeros(n + 200)
    for t in range(5, n + 200):
        x[t] = e[t] + sum(f * x[t - 1 - i] for i, f in enumerate(phi)) + sum(f * e[t - 1 - j] for j, f in enumerate(theta))
    return x[200:]


def dense(phi, theta, n):
    """Covariances for an error variance of 1, from the weights of the errors."""
    psi = np.zeros(3000)
    psi[0] = 1
    for j in range(1, len(psi)):
        psi[j] = (theta[j - 1] if j <= len(theta) else 0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(j, len(phi))))
    gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])
    return gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


@pytest.mark.parametrize("phi,theta", [((0.6,), ()), ((), (0.5,)), ((0.5, -0.3), (0.4, 0.2)), ((0.4,), (-0.4,)), ((), (0.5, 0.3, 0.2, 0.1)), ((0.2, 0.1, 0.1, 0.2), (0.3,)), ((), ()), ((0.97,), (-0.9,))])
@pytest.mark.parametrize("n", [6, 150, 300])
def test_likelihood_and_forecasts_are_exact(phi, theta, n):
    phi, theta, y = np.array(phi), np.array(theta), NOISE[:n] + 0.1 * np.cumsum(NOISE[n : 2 * n]) + 3
    whole = dense(phi, theta, n + 5)
    inside, one = np.linalg.inv(whole[:n, :n]), np.ones(n)
    mean = (one @ inside @ y) / (one @ inside @ one)
    variance = (y - mean) @ inside @ (y - mean) / n
    got = arima.Fit(y, phi, theta, True)
    assert got.mean == pytest.approx(mean) and got.variance == pytest.approx(variance)
    minus2 = n * math.log(2 * math.pi * variance) + n + np.linalg.slogdet(whole[:n, :n])[1]
    assert got.minus2 == pytest.approx(minus2, abs=1e-6) and got.aic == pytest.approx(minus2 + 2 * (len(phi) + len(theta) + 2), abs=1e-6)
    ahead, errors = got.forecast(y, 5)
    assert ahead == pytest.approx(whole[n:, :n] @ inside @ (y - mean), abs=1e-8)
    assert errors @ errors.T == pytest.approx(whole[n:, n:] - whole[n:, :n] @ inside @ whole[:n, n:], abs=1e-8)


def test_white_noise_and_first_order_closed_forms():
    y = process((0.7,), (), 500)
    flat = arima.Fit(y, np.zeros(0), np.zeros(0), True)
    assert flat.minus2 == pytest.approx(500 * (math.log(2 * math.pi * y.var()) + 1)) and flat.mean == pytest.approx(y.mean())
    found = arima.fit(y, 1, 0, mean=False)
    f = found.phi[0]
    squares = (1 - f * f) * y[0] ** 2 + ((y[1:] - f * y[:-1]) ** 2).sum()
    assert found.minus2 == pytest.approx(500 * math.log(2 * math.pi * squares / 500) + 500 - math.log(1 - f * f))
    grid = [arima.Fit(y, np.array([g]), np.zeros(0), False).minus2 for g in np.linspace(0.5, 0.9, 401)]
    assert found.minus2 <= min(grid) + 1e-6 and f == pytest.approx(0.7, abs=0.1)


def test_moving_average_finds_the_greatest_likelihood():
    y = process((), (0.6,), 600)
    found = arima.fit(y, 0, 1, mean=False)
    grid = [arima.Fit(y, np.zeros(0), np.array([g]), False).minus2 for g in np.linspace(-0.99, 0.99, 397)]
    assert found.minus2 <= min(grid) + 1e-6 and found.theta[0] == pytest.approx(0.6, abs=0.1)


def test_integrated_series():
    x = 10 + np.cumsum(process((0.5,), (0.4,), 800, seed=3))
    aic, rows = arima.model(x, 1, 1, 1)
    y = np.diff(x)
    found = arima.fit(y, 1, 1, mean=False)
    assert aic == found.aic and found.aic == found.minus2 + 2 * 3
    assert (found.phi[0], found.theta[0]) == (pytest.approx(0.5, abs=0.12), pytest.approx(0.4, abs=0.12))
    # the forecast is the last value and the expected changes; its error the sum of theirs
    n, whole = len(y), dense(found.phi, found.theta, len(y) + 5)
    inside = np.linalg.inv(whole[:n, :n])
    changes, spread = whole[n:, :n] @ inside @ y, whole[n:, n:] - whole[n:, :n] @ inside @ whole[:n, n:]
    total = np.tril(np.ones((5, 5)))
    assert [r[0] for r in rows] == pytest.approx(x[-1] + np.cumsum(changes), rel=1e-6)
    width = arima.Z95 * np.sqrt(found.variance * np.diag(total @ spread @ total.T))
    assert [r[2] - r[0] for r in rows] == pytest.approx(width, rel=1e-5)


def test_more_coefficients_are_never_less_likely():
    y = process((0.5, -0.2), (0.3,), 300)
    likely = {(p, q): arima.fit(y, p, q, True).minus2 for p in range(3) for q in range(3)}
    assert all(likely[p, q] >= likely[p + 1, q] - 1e-3 for p in range(2) for q in range(3)) and all(likely[p, q] >= likely[p, q + 1] - 1e-3 for p in range(3) for q in range(2))


def test_free_numbers_and_coefficients():
    for phi in ([0.5], [0.5, -0.3], [0.2, 0.1, 0.1, 0.2]):
        assert arima.coefficients(arima.free_numbers(np.array(phi))) == pytest.approx(phi)
    for _ in range(50):
        phi = arima.coefficients(random.standard_normal(4) * 3)
        assert np.abs(np.roots([1, *-phi])).max() < 1


@pytest.mark.parametrize("theta", [(), (0.5,), (0.5, -0.3, 0.2, 0.1)])
@pytest.mark.parametrize("block", [1, 3, 128])
def test_filter(monkeypatch, theta, block):
    monkeypatch.setattr(arima, "BLOCK", block)
    columns, out = random.standard_normal((301, 3)), np.zeros((301, 3))
    for t in range(301):
        out[t] = columns[t] - sum(f * out[t - 1 - j] for j, f in enumerate(theta) if t > j)
    assert np.allclose(arima.filtered(columns, np.array(theta)), out)


def test_forecasts_follow_a_line_and_bracket_it():
    x = np.arange(100) * 2.0 + random.standard_normal(100) * 0.1
    rows = arima.arima(x, orders=(0, 1))
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and rows[4][1] == pytest.approx(208, abs=2)
    assert all(low <= f <= high for _, f, low, high, *_ in rows) and arima.arima(x[:20]) == []


def test_grid_in_spark(spark):
    series = {"a": process((0.7,), (), 200), "b": 5 + np.cumsum(process((), (0.5,), 200, seed=9)), "short": NOISE[:10]}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("a", 500, None), ("b", 501, float("nan"))]
    df = spark.createDataFrame(rows, "symbol string, bar_date int, close double").repartition(5)
    got = arima.forecast_by_key(df, "close", steps=3, orders=(0, 1, 2)).collect()
    for k, x in series.items():
        mine = sorted((r.step, r.forecast, r.lower, r.upper, r.p, r.d, r.q, r.aic) for r in got if r.symbol == k)
        assert mine == [pytest.approx(r, rel=1e-6) for r in arima.arima(x, 3, (0, 1, 2))]
    assert {r.symbol for r in got} == {"a", "b"}
    assert arima.forecast_by_key(df.limit(0), "close").count() == 0


def test_dickey_fuller_p_values():
    """MacKinnon's asymptotic critical values have the p values that they are named after."""
    for trend, values in {"c": {-3.43035: 0.01, -2.86154: 0.05, -2.56677: 0.10}, "ct": {-3.95877: 0.01, -3.41049: 0.05, -3.12705: 0.10}}.items():
        for statistic, p in values.items():
            assert arima.df_p_value(statistic, trend) == pytest.approx(p, rel=0.03)
        least, most, switch, *_ = arima.P_SURFACE[trend]
        assert arima.df_p_value(least - 1, trend) == 0 and arima.df_p_value(most + 1, trend) == 1
        assert arima.df_p_value(switch, trend) == pytest.approx(arima.df_p_value(switch + 1e-9, trend), abs=0.01)
        p = [arima.df_p_value(s, trend) for s in np.linspace(-6, 0.6, 200)]
        assert (np.diff(p) > 0).all()


@pytest.mark.parametrize("trend", ["c", "ct"])
@pytest.mark.parametrize("x", [WALK, NOISE[:300], np.cumsum(WALK), process((0.9,), (0.3,), 250)])
def test_dickey_fuller_lags_by_a_regression_each(x, trend):
    n, d = len(x), np.diff(x)
    fixed = [np.ones(n - 1)] + ([np.arange(1.0, n)] if trend == "ct" else [])
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - len(fixed) - 1)

    def fit(k, skip):
        rows = np.column_stack([x[skip:-1], *[f[skip:] for f in fixed], *[d[skip - i : len(d) - i] for i in range(1, k + 1)]])
        beta = np.linalg.solve(rows.T @ rows, rows.T @ d[skip:])
        sse = ((d[skip:] - rows @ beta) ** 2).sum()
        return sse, beta[0] / math.sqrt(sse / (len(rows) - rows.shape[1]) * np.linalg.inv(rows.T @ rows)[0, 0]), len(rows)

    aic = [(n - 1 - most) * math.log(fit(k, most)[0]) + 2 * k for k in range(most + 1)]
    k = int(np.argmin(aic))
    _, statistic, used = fit(k, k)
    got = arima.adf(x, trend)
    assert got[0] == pytest.approx(statistic, rel=1e-4) and got[2:4] == (k, used) and got[1] == arima.df_p_value(got[0], trend)


def test_dickey_fuller_tells_a_walk_from_noise():
    assert arima.adf(WALK)[1] > 0.1 and arima.adf(NOISE[:300])[1] < 0.01
    assert arima.differences(WALK) == 1 and arima.differences(NOISE[:300]) == 0 and arima.differences(np.cumsum(WALK)) == 2
