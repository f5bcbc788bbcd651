"""Dickey-Fuller tests, and ARIMA models by exact maximum likelihood.

An ARMA process of order (p, q) depends on what came before its first value only through
u = (p values, q errors).  Given u the errors follow by a recursion that is linear in the data and in u;
u is Gaussian with a known covariance, so integrating it out leaves the exact Gaussian likelihood of the
data, the same number as a Kalman filter's over the state-space form, with one recursive filter in place
of a step a value.  The mean (only without differencing) and the error variance have closed forms
for given coefficients; these are searched by BFGS over partial autocorrelations, so that every
step is stationary and invertible.

forecast_by_key() lays the grid of orders out as rows (key, p, q): the fits of one key's series spread
over tasks, and the order with the least AIC stays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Rows that the recursive filter works on at a time.
BLOCK = 128
ORDERS = (0, 1, 2, 3, 4)
Z95 = 1.959963984540054
LEAST_VALUES = 30
FITS_A_TASK = 8

# MacKinnon's published response surfaces for the Dickey-Fuller test with a constant (c) and with a trend too (ct).
CRITICAL = {
    "c": {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)},
    "ct": {0.01: (-3.95877, -9.0531, -28.428, -134.155), 0.05: (-3.41049, -4.3904, -9.036, -45.374), 0.10: (-3.12705, -2.5856, -3.925, -22.380)},
}
#: Least and greatest statistic, where the lower polynomial gives way to the upper, and both, in powers of the statistic.
P_SURFACE = {
    "c": (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (-16.18, 0.7, -2.89, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}


def df_p_value(statistic: float, trend: str = "c") -> float:
    """MacKinnon's approximate p value."""
    least, most, switch, lower, upper = P_SURFACE[trend]
    if statistic > most:
        return 1.0
    if statistic < least:
        return 0.0
    x = sum(c * statistic**i for i, c in enumerate(lower if statistic <= switch else upper))
    return 0.5 * math.erfc(-x / math.sqrt(2))


def adf(x: np.ndarray, trend: str = "c") -> tuple[float, float, int, int, float, float, float]:
    """Augmented Dickey-Fuller: statistic, p value, lags, observations, and the 1, 5 and 10 % values.

    Lags are chosen by AIC over a common sample: in one QR factorisation with the lags as last columns
    each column takes its share off the sum of squares.  The regression is then redone with all
    observations that the chosen lags leave.
    """
    n, d = len(x), np.diff(x)
    fixed = [np.ones(n - 1), *([np.arange(1.0, n)] if trend == "ct" else [])]
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - len(fixed) - 1))

    def regression(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        columns = [x[skip:-1], *[f[skip:] for f in fixed], *[d[skip - i : len(d) - i] for i in range(1, lags + 1)]]
        return d[skip:], np.column_stack(columns)

    y, columns = regression(most, most)
    q, _ = np.linalg.qr(columns)
    left = np.maximum((y**2).sum() - np.cumsum((q.T @ y) ** 2), 1e-300)[len(fixed) :]
    lags = int(np.argmin(len(y) * np.log(left / len(y)) + 2 * np.arange(len(left))))
    y, columns = regression(lags, lags)
    beta, *_ = np.linalg.lstsq(columns, y, rcond=None)
    sse = float(((y - columns @ beta) ** 2).sum())
    error = math.sqrt(max(sse / max(len(y) - columns.shape[1], 1) * np.linalg.pinv(columns.T @ columns)[0, 0], 0.0))
    statistic = float(beta[0] / error) if error > 0 else -math.inf
    values = [sum(c / len(y) ** i for i, c in enumerate(CRITICAL[trend][p])) for p in (0.01, 0.05, 0.10)]
    return statistic, df_p_value(statistic, trend), lags, len(y), *values


def differences(x: np.ndarray, most: int = 2, significance: float = 0.05) -> int:
    """How often the series has to be differenced until it is stationary, at most `most` times."""
    d = 0
    while d < most and len(x) > 20 and adf(x)[1] >= significance:
        x, d = np.diff(x), d + 1
    return d


def coefficients(free: np.ndarray) -> np.ndarray:
    """Those of a stationary autoregression, from free numbers as partial autocorrelations (Durbin-Levinson)."""
    out = np.zeros(0)
    for r in free / np.sqrt(1 + free**2):
        out = np.append(out - r * out[::-1], r)
    return out


def free_numbers(phi: np.ndarray) -> np.ndarray:
    """The inverse, for a start: partial autocorrelations beyond 0.97 are drawn in."""
    out, phi = np.zeros(len(phi)), phi.copy()
    for k in range(len(phi) - 1, -1, -1):
        r = float(np.clip(phi[k], -0.97, 0.97))
        out[k] = r / math.sqrt(1 - r * r)
        rest = phi[:k]
        phi = (rest + r * rest[::-1]) / (1 - r * r)
    return out


def filtered(columns: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """e with e[t] = columns[t] - sum(theta[j] e[t - 1 - j]), nothing before the first, BLOCK rows at a time."""
    q, n = len(theta), len(columns)
    if not q:
        return columns
    size = max(BLOCK, q)
    pulse = np.zeros(size + q)  # what an error of 1 leaves in later ones, after q zeros
    pulse[q] = 1
    for t in range(1, size):
        pulse[q + t] = -pulse[t : q + t][::-1] @ theta
    pulse = pulse[q:]
    at = np.subtract.outer(np.arange(size), np.arange(size))
    within = np.where(at >= 0, pulse[np.maximum(at, 0)], 0.0)
    before = np.zeros((size, q))  # the last q errors, oldest first, as they enter the block
    for j in range(q):
        before[: q - j, q - 1 - j] = 0
        for t in range(q):
            if t + j < q:
                before[t, q - 1 - j] = -theta[t + j]
    carried = within @ before
    out, last = np.empty_like(columns), np.zeros((q, columns.shape[1]))
    for a in range(0, n, size):
        k = min(size, n - a)
        out[a : a + k] = within[:k, :k] @ columns[a : a + k] + carried[:k] @ last
        last = np.vstack([last, out[max(a, a + k - q) : a + k]])[-q:]
    return out


def covariance_before(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of (values 0, -1, .., errors 0, -1, ..) before the first, for an error variance of 1."""
    p, q = len(phi), len(theta)
    psi = np.zeros(max(p, q) + 1)
    psi[0] = 1
    for j in range(1, len(psi)):
        psi[j] = (theta[j - 1] if j <= q else 0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(j, p)))
    ma = np.append(1.0, theta)
    system, right = np.eye(p + 1), np.zeros(p + 1)
    for k in range(p + 1):  # each autocovariance by those around it
        for i in range(p):
            system[k, abs(k - 1 - i)] -= phi[i]
        right[k] = sum(ma[j] * psi[j - k] for j in range(k, q + 1))
    gamma = np.linalg.solve(system, right)
    out = np.eye(p + q)
    for i in range(p):
        for j in range(p):
            out[i, j] = gamma[abs(i - j)]
        for j in range(i, q):
            out[i, p + j] = out[p + j, i] = psi[j - i]
    return out


class Fit:
    """The likelihood of a series at given coefficients, mean and variance at their best."""

    def __init__(self, y: np.ndarray, phi: np.ndarray, theta: np.ndarray, mean: bool):
        p, q, n = len(phi), len(theta), len(y)
        self.phi, self.theta = phi, theta
        data = np.column_stack([y, np.ones(n)]) if mean else y[:, None]
        columns = np.zeros((n, data.shape[1] + p + q))
        own, begin = columns[:, : data.shape[1]], columns[:, data.shape[1] :]
        own[:] = data
        for i in range(p):
            own[i + 1 :] -= phi[i] * data[: n - 1 - i]
            m = min(p - i, n)
            begin[:m, i] = -phi[i : i + m]
        for j in range(q):
            m = min(q - j, n)
            begin[:m, p + j] = -theta[j : j + m]
        errors = filtered(columns, theta)
        e, z = errors[:, : data.shape[1]], errors[:, data.shape[1] :]
        values, vectors = np.linalg.eigh(covariance_before(phi, theta)) if p + q else (np.zeros(0), np.zeros((0, 0)))
        root = vectors * np.sqrt(np.maximum(values, 0))
        inner = np.eye(p + q) + root.T @ (z.T @ z) @ root
        cross = root.T @ (z.T @ e)
        solved = np.linalg.solve(inner, cross)
        gram = e.T @ e - cross.T @ solved
        self.mean = float(gram[0, 1] / gram[1, 1]) if mean else 0.0
        scale = np.array([1.0, -self.mean])[: data.shape[1]]
        squares = max(float(scale @ gram @ scale), 1e-300)
        self.variance = squares / n
        self.minus2 = n * math.log(2 * math.pi * self.variance) + n + np.linalg.slogdet(inner)[1]
        self.aic = self.minus2 + 2 * (p + q + mean + 1)
        self._state = e @ scale, z, root, solved @ scale, inner

    def errors(self) -> np.ndarray:
        """Expected errors, given all values."""
        e, z, root, best, _ = self._state
        return e - z @ (root @ best)

    def forecast(self, y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected values less the mean, and the matrix of their errors: steps x (errors to come, beginnings)."""
        p, q, n = len(self.phi), len(self.theta), len(y)
        _, z, root, _, inner = self._state
        uncertain = z @ root @ np.linalg.inv(np.linalg.cholesky(inner)).T if p + q else z
        past, errors = list(y - self.mean), list(self.errors())
        spread, sources = [np.zeros(steps + p + q)] * (p + 1), [np.concatenate([np.zeros(steps), -row]) for row in (uncertain[-q:] if q else [])]
        for h in range(steps):
            new = np.zeros(steps + p + q)
            new[h] = 1
            past.append(sum(self.phi[i] * past[-1 - i] for i in range(p)) + sum(self.theta[j] * errors[-1 - j] for j in range(min(q, len(errors)))))
            spread.append(new + sum((self.phi[i] * spread[-1 - i] for i in range(p)), np.zeros(steps + p + q)) + sum((self.theta[j] * sources[-1 - j] for j in range(q)), np.zeros(steps + p + q)))
            errors.append(0.0)
            sources.append(new)
        return np.array(past[n:]), np.array(spread[p + 1 :])


def fit(y: np.ndarray, p: int, q: int, mean: bool, rounds: int = 100) -> Fit:
    """The ARMA model of greatest likelihood, by BFGS from two starts."""

    def at(x: np.ndarray) -> Fit:
        return Fit(y, coefficients(x[:p]), -coefficients(x[p:]), mean)

    def value(x: np.ndarray) -> float:
        return at(x).minus2 / len(y) if np.abs(x).max(initial=0) < 300 else math.inf

    best = None
    for start in _starts(y - y.mean() if mean else y, p, q):
        x, f = start, value(start)
        inverse, g = np.eye(p + q), _gradient(value, start)
        for _ in range(rounds if p + q else 0):
            step = -inverse @ g
            if step @ g > -1e-14:
                inverse, step = np.eye(p + q), -g
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
            size, new = 1.0, math.inf
            while size > 1e-8 and not (new := value(x + size * step)) <= f + 1e-4 * size * (step @ g):
                size /= 2
            if not new < f:
                break
            moved, gained = size * step, f - new
            x, f, last, g = x + moved, new, g, _gradient(value, x + moved)
            change = g - last
            if not np.isfinite(g).all():
                break
            if (rise := moved @ change) > 1e-14:
                left = np.eye(p + q) - np.outer(moved, change) / rise
                inverse = left @ inverse @ left.T + np.outer(moved, moved) / rise
            if np.abs(g).max(initial=0) < 1e-6 or gained < 1e-10:
                break
        if best is None or f < best[0]:
            best = f, x
    return at(best[1])


def _gradient(value, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for i in range(len(x)):
        h = 1e-5 * max(1.0, abs(x[i]))
        up, down = x.copy(), x.copy()
        up[i] += h
        down[i] -= h
        out[i] = (value(up) - value(down)) / (2 * h)
    return out


def _starts(y: np.ndarray, p: int, q: int) -> list[np.ndarray]:
    """All zeros, and regression on own lags and on the errors of a long autoregression."""
    starts = [np.zeros(p + q)]
    long = min(p + q + 5, len(y) // 4)
    lags = lambda x, k, skip: [x[skip - i : len(x) - i] for i in range(1, k + 1)]
    if p + q and long > p + q:
        rows = np.column_stack(lags(y, long, long))
        e = np.concatenate([np.zeros(long), y[long:] - rows @ np.linalg.lstsq(rows, y[long:], rcond=None)[0]])
        skip = long + max(p, q)
        beta = np.linalg.lstsq(np.column_stack(lags(y, p, skip) + lags(e, q, skip)), y[skip:], rcond=None)[0]
        starts.append(np.concatenate([free_numbers(beta[:p]), free_numbers(-beta[p:])]))
    return starts


def model(x: np.ndarray, p: int, d: int, q: int, steps: int = 5, z: float = Z95) -> tuple[float, list[tuple[float, float, float]]]:
    """AIC of ARIMA(p, d, q), and forecast with its bounds for each step."""
    y = np.diff(x, d)
    found = fit(y, p, q, mean=d == 0)
    ahead, errors = found.forecast(y, steps)
    ahead = ahead + found.mean
    for k in range(d, 0, -1):
        ahead, errors = np.cumsum(ahead) + np.diff(x, k - 1)[-1], np.cumsum(errors, axis=0)
    spread = z * np.sqrt(found.variance * (errors**2).sum(axis=1))
    return float(found.aic), [(float(f), float(f - w), float(f + w)) for f, w in zip(ahead, spread, strict=True)]


def arima(x: np.ndarray, steps: int = 5, orders: tuple[int, ...] = ORDERS) -> list[tuple]:
    """(step, forecast, lower, upper, p, d, q, aic) of the order with the least AIC; none for fewer than LEAST_VALUES values."""
    if len(x) < LEAST_VALUES:
        return []
    d = differences(x)
    aic, p, q, rows = min((*(made := model(x, p, d, q, steps))[:1], p, q, made[1]) for p in orders for q in orders)
    return [(i, *row, p, d, q, aic) for i, row in enumerate(rows, 1)]


def forecast_by_key(df: DataFrame, value: str, steps: int = 5, orders: tuple[int, ...] = ORDERS, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """(key, step, forecast, lower, upper, p, d, q, aic): arima() of every key's values in date order, nulls left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(key).alias("key"), F.struct(F.col(date).alias("at"), F.col(value).cast("double").alias("x")).alias("row"))
    series = kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["x"]).alias("x")).where(F.size("x") >= LEAST_VALUES)  # one instrument's history

    @F.pandas_udf("int")
    def often(x: pd.Series) -> pd.Series:
        return x.map(differences).astype("int32")

    grid = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in orders for q in orders]
    series = written(series.withColumn("d", often("x")), "arima-series")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, series.count() * len(grid) // FITS_A_TASK)
    jobs = series.withColumn("order", F.explode(F.array(*grid))).repartition(parts, "key", "order")

    @F.pandas_udf("struct<aic:double,rows:array<struct<forecast:double,lower:double,upper:double>>>")
    def fitted(x: pd.Series, p: pd.Series, d: pd.Series, q: pd.Series) -> pd.DataFrame:
        made = [model(*job, steps) for job in zip(x, p, d, q, strict=True)]
        rows = [[dict(zip(("forecast", "lower", "upper"), r, strict=True)) for r in rows] for _, rows in made]
        return pd.DataFrame({"aic": [aic for aic, _ in made], "rows": rows})

    fits = jobs.select("key", "d", "order.p", "order.q", fitted("x", "order.p", "d", "order.q").alias("fit"))
    best = fits.groupBy("key").agg(F.min_by(F.struct("p", "d", "q", "fit"), F.struct("fit.aic", "p", "q")).alias("b"))
    out = best.select(F.col("key").alias(key), F.posexplode("b.fit.rows").alias("i", "row"), "b.p", "b.d", "b.q", F.col("b.fit.aic").alias("aic"))
    return out.select(key, (F.col("i") + 1).alias("step"), "row.forecast", "row.lower", "row.upper", "p", "d", "q", "aic")
