"""Queries of the series operators: windows, indicators, risk, statistics, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market, monitoring, risk, series, statistics
from ..operators.factors import Periods, factor_panel
from ..operators.recurrence import spread_recurrences, with_recurrences
from .inputs import AS_OF, BARS, RETURNS, bars, r, rounded, table
from .registry import query
from .relational import OUTCOMES, predictions

S, D = SparkSession, DataFrame
W = series.window
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)"


def _rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(value: str, of: str, n: int, digits: int = 6) -> str:
    return f"CASE WHEN count({of}) OVER {_rows(n)} = {n} THEN round({value}, {digits}) + 0.0 END"


def _returns(spark: S, sf: str) -> D:
    return series.with_returns(bars(spark, sf))


@query(f"WITH {RETURNS} SELECT symbol, bar_date, round(ret, 6) + 0.0 AS ret, round(close / lag(close, 5) OVER w - 1, 6) + 0.0 AS ret5, round(ln(close / lag(close) OVER w), 6) + 0.0 AS log_ret FROM r {_W}")
def returns(spark: S, sf: str) -> D:
    return bars(spark, sf).select("symbol", "bar_date", r(series.change("close", W())).alias("ret"), r(series.change("close", W(), 5)).alias("ret5"), r(series.log_change("close", W())).alias("log_ret"))


@query(f"WITH {BARS} SELECT symbol, bar_date, round(avg(close) OVER {_rows(20)}, 4) AS ma20_partial, {_full(f'avg(close) OVER {_rows(60)}', 'close', 60, 4)} AS ma60 FROM bars")
def moving_averages(spark: S, sf: str) -> D:
    return bars(spark, sf).select("symbol", "bar_date", r(series.mean("close", W(), 20, partial=True), 4).alias("ma20_partial"), r(series.mean("close", W(), 60), 4).alias("ma60"))


@query(f"WITH {BARS}, b AS (SELECT symbol, bar_date, avg(close) OVER x AS m, stddev_samp(close) OVER x AS s, count(close) OVER x AS n FROM bars WINDOW x AS {_rows(20)}) SELECT symbol, bar_date, CASE WHEN n = 20 THEN round(m + 2 * s, 4) END AS upper, CASE WHEN n = 20 THEN round(m, 4) END AS middle, CASE WHEN n = 20 THEN round(m - 2 * s, 4) + 0.0 END AS lower FROM b")
def bollinger_bands(spark: S, sf: str) -> D:
    up, mid, low = series.bollinger("close", W())
    return bars(spark, sf).select("symbol", "bar_date", r(up, 4).alias("upper"), r(mid, 4).alias("middle"), r(low, 4).alias("lower"))


@query(f"WITH {RETURNS} SELECT symbol, bar_date, {_full(f'stddev_samp(ret) OVER {_rows(20)} * sqrt(252)', 'ret', 20)} AS volatility FROM r")
def rolling_volatility(spark: S, sf: str) -> D:
    return _returns(spark, sf).select("symbol", "bar_date", r(series.volatility("ret", W())).alias("volatility"))


@query(f"WITH {BARS}, d AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS v FROM bars {_W}) SELECT symbol, bar_date, sum(v) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) + 0.0 AS obv FROM d")
def on_balance_volume(spark: S, sf: str) -> D:
    rows = bars(spark, sf).withColumn("v", series.on_balance_volume("close", "volume", W()))
    return rows.select("symbol", "bar_date", (series.running_sum("v", W()) + 0.0).alias("obv"))


@query(f"""WITH {BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), d AS (SELECT *, tp - lag(tp) OVER w AS m FROM t {_W}),
f AS (SELECT *, CASE WHEN m > 0 THEN tp * volume ELSE 0 END AS u, CASE WHEN m < 0 THEN tp * volume ELSE 0 END AS v FROM d),
g AS (SELECT symbol, bar_date, sum(u) OVER x / nullif(sum(v) OVER x, 0) AS q, count(*) OVER x AS n FROM f WINDOW x AS {_rows(14)})
SELECT symbol, bar_date, CASE WHEN n = 14 THEN round(100 - 100 / (1 + q), 4) + 0.0 END AS mfi FROM g""")
def money_flow_index(spark: S, sf: str) -> D:
    return series.money_flow_index(bars(spark, sf)).select("symbol", "bar_date", r(F.col("mfi"), 4).alias("mfi"))


@query(f"""WITH {BARS}, a AS (SELECT symbol, bar_date, list(high) OVER x AS h, list(low) OVER x AS l FROM bars WINDOW x AS {_rows(20)})
SELECT symbol, bar_date, CASE WHEN len(h) = 20 THEN list_position(h, list_max(h)) / 20::DOUBLE * 100 END AS up, CASE WHEN len(l) = 20 THEN list_position(l, list_min(l)) / 20::DOUBLE * 100 END AS down FROM a""")
def aroon(spark: S, sf: str) -> D:
    return bars(spark, sf).select("symbol", "bar_date", series.aroon("high", W(), 20, True).alias("up"), series.aroon("low", W(), 20, False).alias("down"))


@query(f"""WITH {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {_W})
SELECT symbol, bar_date, round(avg(tr) OVER {_rows(14)}, 4) AS atr, CASE WHEN count(*) OVER {_rows(60)} = 60 THEN round(close / max(high) OVER {_rows(60)}, 6) END AS to_high, round((close - min(close) OVER {_rows(60)}) / (max(close) OVER {_rows(60)} - min(close) OVER {_rows(60)} + 1e-8), 6) + 0.0 AS place FROM t""")
def ranges(spark: S, sf: str) -> D:
    rows = bars(spark, sf).withColumn("tr", series.true_range(W()))
    return rows.select("symbol", "bar_date", r(F.avg("tr").over(series.last(W(), 14)), 4).alias("atr"), r(F.col("close") / series.highest("high", W(), 60)).alias("to_high"), r(series.min_max("close", W())).alias("place"))


@query(f"""WITH {BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), f AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * tp * volume AS flow FROM t {_W}),
c AS (SELECT symbol, quantile_cont(coalesce(amount, 0), 0.3) AS lo, quantile_cont(coalesce(amount, 0), 0.7) AS hi FROM bars GROUP BY symbol)
SELECT symbol, bar_date, round(flow, 4) + 0.0 AS flow, CASE WHEN amount <= lo THEN 'small' WHEN amount <= hi THEN 'medium' ELSE 'large' END AS tier FROM f JOIN c USING (symbol)""")
def money_flow_tiers(spark: S, sf: str) -> D:
    return series.money_flow(bars(spark, sf)).select("symbol", "bar_date", r(F.col("flow"), 4).alias("flow"), "tier")


@query(f"""WITH {BARS}, p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS peak FROM bars), d AS (SELECT *, (close - peak) / peak AS dd FROM p),
t AS (SELECT symbol, min(dd) AS dd, min_by(bar_date, (dd, bar_date)) AS trough_date, min_by(peak, (dd, bar_date)) AS peak FROM d GROUP BY symbol)
SELECT t.symbol, round(t.dd, 6) AS max_drawdown, (SELECT min(bar_date) FROM bars WHERE bars.symbol = t.symbol AND close = t.peak AND bar_date <= t.trough_date) AS peak_date, trough_date FROM t""")
def drawdown_dates(spark: S, sf: str) -> D:
    return rounded(series.drawdown_dates(bars(spark, sf)))


def _resampled(label: str) -> str:
    return f"WITH {BARS} SELECT symbol, {label} AS bar_date, min_by(open, bar_date) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_date) AS close, sum(volume) AS volume, round(sum(amount), 2) AS amount FROM bars GROUP BY 1, 2"


@query(_resampled("CAST(bar_date + CAST((8 - isodow(bar_date)) % 7 AS INTEGER) AS DATE)"))
def resample_weekly(spark: S, sf: str) -> D:
    return series.resample(bars(spark, sf), "week").withColumn("amount", F.round("amount", 2))


@query(_resampled("last_day(bar_date)"))
def resample_monthly(spark: S, sf: str) -> D:
    return series.resample(bars(spark, sf), "month").withColumn("amount", F.round("amount", 2))


@query(f"""WITH {BARS}, g AS (SELECT symbol, bar_date, CASE WHEN day(bar_date) % 3 <> 0 THEN close END AS c FROM bars)
SELECT symbol, bar_date, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING), 0) AS filled,
  coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING), first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled_back FROM g""")
def fill_gaps(spark: S, sf: str) -> D:
    rows = bars(spark, sf).select("symbol", "bar_date", F.when(F.dayofmonth("bar_date") % 3 != 0, F.col("close")).alias("c"))
    return rows.select("symbol", "bar_date", series.fill("c", W()).alias("filled"), series.fill("c", W(), backward=True).alias("filled_back"))


@query(f"WITH {BARS} SELECT symbol, bar_date, round((close / first_value(close) OVER w - 1) * 100, 6) + 0.0 AS rebased FROM bars {_W}")
def rebased_curve(spark: S, sf: str) -> D:
    return bars(spark, sf).select("symbol", "bar_date", r(series.rebased("close", W())).alias("rebased"))


@query(f"""WITH {BARS}, k AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS b, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, {', '.join(f"round(max(close) FILTER (b = 1) / max(close) FILTER (b = least({n}, n)) - 1, 6) + 0.0 AS {name}" for name, n in (('m1', 21), ('m3', 63), ('m6', 126), ('y1', 252)))} FROM k GROUP BY symbol""")
def period_returns(spark: S, sf: str) -> D:
    return rounded(series.period_returns(bars(spark, sf), {"m1": 21, "m3": 63, "m6": 126, "y1": 252}))


@query(f"WITH {BARS} SELECT symbol, bar_date, round((close - avg(close) OVER k) / (stddev_pop(close) OVER k + 1e-8), 6) + 0.0 AS close FROM bars WINDOW k AS (PARTITION BY symbol)")
def z_scores(spark: S, sf: str) -> D:
    return rounded(series.z_score(bars(spark, sf).select("symbol", "bar_date", "close"), ["close"]))


@query(f"WITH {RETURNS}, q AS (SELECT symbol, bar_date, ret, volume / lag(volume) OVER w - 1 AS vc FROM r {_W}) SELECT symbol, bar_date, round(greatest(-1.0, least(1.0, -coalesce(CASE WHEN isnan(corr(ret, vc) OVER x) THEN 0 ELSE corr(ret, vc) OVER x END, 0))), 4) + 0.0 AS divergence FROM q WINDOW x AS {_rows(10)}")
def price_volume_divergence(spark: S, sf: str) -> D:
    rows = _returns(spark, sf).withColumn("vc", series.change("volume", W()))
    return rows.select("symbol", "bar_date", r(series.price_volume_divergence("ret", "vc", W()), 4).alias("divergence"))


@query(f"WITH {RETURNS} SELECT symbol, bar_date, round(ret, 6) + 0.0 AS x0, round(lead(ret, 2) OVER w, 6) + 0.0 AS x1, round(lead(ret, 4) OVER w, 6) + 0.0 AS x2 FROM r {_W} QUALIFY lead(ret, 4) OVER w IS NOT NULL")
def phase_space(spark: S, sf: str) -> D:
    return rounded(series.phase_space(_returns(spark, sf), "ret", 2, 3))


@query(f"""WITH {BARS}, q AS (SELECT symbol, bar_date, close, list(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS f, lead(close, 5) OVER w AS l5, lead(close) OVER w AS l1 FROM bars {_W})
SELECT symbol, bar_date, round(list_avg(f), 4) AS mean60, round(l1 / close - 1, 6) + 0.0 AS next_return, CAST(l5 > close AS INTEGER) AS direction FROM q WHERE len(f) = 60 AND l5 IS NOT NULL""")
def sliding_sequences(spark: S, sf: str) -> D:
    rows = series.sequences(bars(spark, sf), ["close", "volume"])
    mean = F.aggregate("features", F.lit(0.0), lambda a, x: a + x[0]) / 60
    return rows.select("symbol", "bar_date", r(mean, 4).alias("mean60"), r(F.col("forward")[0]).alias("next_return"), "direction")


@query(f"""WITH {BARS}, q AS (SELECT *, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS ret, coalesce(volume / nullif(lag(volume) OVER w, 0) - 1, 0) AS volume_change, lag(close) OVER w AS b, first_value(close) OVER w AS f FROM bars {_W}),
v AS (SELECT *, stddev_samp(ret) OVER {_rows(5)} AS s5, stddev_samp(ret) OVER {_rows(20)} AS s20, corr(ret, volume_change) OVER {_rows(10)} AS c, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM q),
x AS (SELECT *, coalesce(s5, 0) AS hv5, coalesce(s20, 0) AS hv20, 2 * CASE WHEN sd > 1e-12 THEN sd ELSE 0.01 END AS top FROM v)
SELECT symbol, bar_date, open, high, low, close, volume, amount, round(ret, 6) + 0.0 AS ret, round(volume_change, 6) + 0.0 AS volume_change, round(abs(ret), 6) + 0.0 AS abs_ret, CAST(sign(ret) AS DOUBLE) AS sign_ret,
  round((high - low) / (close + 1e-8), 6) + 0.0 AS range_ratio, round(coalesce((open - b) / (coalesce(nullif(b, 0), f) + 1e-8), 0), 6) + 0.0 AS gap, round(hv5, 6) + 0.0 AS hv5, round(hv20, 6) + 0.0 AS hv20,
  round(greatest(least(-CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END, 1), -1), 4) + 0.0 AS divergence, round(hv5 / (hv20 + 1e-8), 6) + 0.0 AS hv_ratio, CAST(ret > top AS INTEGER)::DOUBLE AS is_jump, CAST(ret < -top AS INTEGER)::DOUBLE AS is_crash FROM x""")
def volatility_features(spark: S, sf: str) -> D:
    out = series.volatility_block(bars(spark, sf))
    return rounded(out.withColumn("divergence", F.round("divergence", 4)))


_EMA = """WITH RECURSIVE {bars}, k AS (SELECT symbol, bar_date, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS i FROM bars),
e AS (SELECT symbol, bar_date, i, close AS f, close AS s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, close, 0.0::DOUBLE AS sig FROM k WHERE i = 1
  UNION ALL SELECT k.symbol, k.bar_date, k.i, e.f + (k.close - e.f) * 2 / 13, e.s + (k.close - e.s) * 2 / 27, e.g + (greatest(k.close - e.close, 0) - e.g) / 14, e.l + (greatest(e.close - k.close, 0) - e.l) / 14, k.close,
    e.sig + ((e.f + (k.close - e.f) * 2 / 13) - (e.s + (k.close - e.s) * 2 / 27) - e.sig) * 2 / 10 FROM e JOIN k ON k.symbol = e.symbol AND k.i = e.i + 1)
SELECT symbol, bar_date, round(f, 3) AS ema_12, CASE WHEN l > 0 THEN round(100 - 100 / (1 + g / l), 3) + 0.0 END AS rsi_14, round(f - s, 3) + 0.0 AS macd, round(sig, 3) + 0.0 AS macd_signal FROM e"""


@query(_EMA.format(bars=BARS))
def recurrences(spark: S, sf: str) -> D:
    out = with_recurrences(bars(spark, sf), emas=(12,))
    return rounded(out.select("symbol", "bar_date", "ema_12", "rsi_14", "macd", "macd_signal"), 3)


@query(_EMA.format(bars=BARS))
def recurrences_spread(spark: S, sf: str) -> D:
    """The same numbers with each symbol's history dealt over several tasks."""
    out = spread_recurrences(bars(spark, sf), emas=(12,), parts=24)
    return rounded(out.select("symbol", "bar_date", "ema_12", "rsi_14", "macd", "macd_signal"), 3)


_RISK = f"""{RETURNS}, p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS peak FROM r),
a AS (SELECT symbol, count(*) AS n, min_by(close, bar_date) AS f, max_by(close, bar_date) AS l, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dn, min((close - peak) / peak) AS dd,
  avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INTEGER) END) AS wr, avg(ret) FILTER (ret > 0) AS gn, avg(ret) FILTER (ret < 0) AS ls FROM p GROUP BY symbol),
x AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE pow(l / f, 252.0 / n) - 1 END AS ar FROM a)"""


@query(f"""WITH {_RISK} SELECT symbol, n, round(ar, 6) + 0.0 AS annual_return, round(sd * sqrt(252), 6) AS volatility, round(coalesce((ar - 0.03) / nullif(sd * sqrt(252), 0), 0), 6) + 0.0 AS sharpe, round(dd, 6) + 0.0 AS max_drawdown,
  round(coalesce(ar / nullif(abs(dd), 0), 0), 6) + 0.0 AS calmar, round(coalesce((ar - 0.03) / nullif(dn * sqrt(252), 0), 0), 6) + 0.0 AS sortino, round(wr, 6) AS win_rate, round(coalesce(gn / nullif(abs(ls), 0), 0), 6) AS profit_loss_ratio FROM x""")
def risk_metrics(spark: S, sf: str) -> D:
    return rounded(risk.risk_metrics(bars(spark, sf)))


@query(f"WITH {RETURNS}, v AS (SELECT symbol, quantile_cont(ret, 0.05) AS var FROM r GROUP BY symbol) SELECT symbol, round(any_value(var), 6) AS var, round(avg(ret) FILTER (ret <= var), 6) AS cvar FROM r JOIN v USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol")
def value_at_risk(spark: S, sf: str) -> D:
    return rounded(risk.value_at_risk(_returns(spark, sf)))


def _benchmark(spark: S, sf: str) -> D:
    return _returns(spark, sf).where("symbol = '5-LOW'").select("bar_date", F.col("ret").alias("bench_ret"))


@query(f"""WITH {RETURNS}, b AS (SELECT bar_date, ret AS br FROM r WHERE symbol = '5-LOW'), j AS (SELECT symbol, ret, br, ret - 0.03 / 252 AS y, br - 0.03 / 252 AS x FROM r JOIN b USING (bar_date) WHERE ret IS NOT NULL AND br IS NOT NULL),
a AS (SELECT symbol, count(*) AS n, covar_samp(y, x) / var_samp(x) AS beta, avg(y) AS my, avg(x) AS mx, corr(ret, br) AS c, avg(ret - br) AS g, stddev_samp(ret - br) AS gs, stddev_samp(br) AS bs FROM j GROUP BY symbol)
SELECT symbol, n, round((my - beta * mx) * 252, 4) + 0.0 AS alpha, round(beta, 4) + 0.0 AS beta, round(c * c, 4) AS r_squared, round(coalesce(g * 252 / nullif(gs * sqrt(252), 0), 0), 4) + 0.0 AS information_ratio, round(gs * sqrt(252), 4) AS tracking_error, round(bs * sqrt(252), 4) AS benchmark_volatility, round(bs * 252, 4) AS benchmark_volatility_compat FROM a""")
def benchmark_metrics(spark: S, sf: str) -> D:
    return rounded(risk.benchmark_metrics(_returns(spark, sf), _benchmark(spark, sf)), 4)


@query(f"WITH {BARS} SELECT symbol, round(sqrt(avg((close - open) ** 2)), 4) AS rmse, round(avg(abs(close - open)), 4) AS mae, round(avg(abs((close - open) / close)) * 100, 4) AS mape, round(1 - sum((close - open) ** 2) / (var_pop(close) * count(*)), 4) + 0.0 AS r2 FROM bars GROUP BY symbol")
def error_metrics(spark: S, sf: str) -> D:
    return rounded(risk.regression_errors(bars(spark, sf), "close", "open"), 4)


@query(f"""WITH {RETURNS}, m AS (SELECT symbol, avg(ret) AS mu, count(ret) AS n, stddev_samp(ret) AS sd FROM r GROUP BY symbol), c AS (SELECT symbol, avg((ret - mu) ** 2) AS m2, avg((ret - mu) ** 3) AS m3, avg((ret - mu) ** 4) AS m4 FROM r JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol),
k AS (SELECT symbol, n, mu, sd, m3 / m2 ** 1.5 AS s, m4 / (m2 * m2) - 3 AS q FROM c JOIN m USING (symbol))
SELECT symbol, n, round(mu, 5) AS mean, round(sd, 5) AS std, round(s, 5) AS skewness, round(q, 5) AS kurtosis, round(n / 6 * (s * s + q * q / 4), 3) AS jarque_bera, round(exp(-n / 12 * (s * s + q * q / 4)), 5) AS jb_p_value FROM k""")
def basic_stats(spark: S, sf: str) -> D:
    out = statistics.basic_stats(_returns(spark, sf), "ret")
    return rounded(out.withColumn("jarque_bera", F.round("jarque_bera", 3)), 5)


@query(f"WITH {BARS} SELECT symbol, min(bar_date) AS first_date, max(bar_date) AS last_date, count(*) AS n, min_by(close, bar_date) AS first_price, max_by(close, bar_date) AS last_price, max(close) AS max_price, min(close) AS min_price, round(avg(close), 4) AS mean_price, round(stddev_samp(close), 4) AS std_price, round((max_by(close, bar_date) / min_by(close, bar_date) - 1) * 100, 4) + 0.0 AS change_pct FROM bars GROUP BY symbol")
def price_overview(spark: S, sf: str) -> D:
    return rounded(statistics.overview(bars(spark, sf)), 4)


@query(f"""WITH {RETURNS}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS i FROM r WHERE ret IS NOT NULL), m AS (SELECT symbol, avg(ret) AS mu, var_pop(ret) AS v, count(*) AS n FROM k GROUP BY symbol)
SELECT a.symbol, CAST(l AS INTEGER) AS lag, round(sum((a.ret - mu) * (b.ret - mu)) / any_value(v * n), 6) + 0.0 AS acf FROM range(1, 21) t(l), k a JOIN k b ON a.symbol = b.symbol AND a.i = b.i + l JOIN m ON m.symbol = a.symbol GROUP BY ALL""")
def autocorrelation(spark: S, sf: str) -> D:
    """The first 20 lags, as in the SQL; autocorrelation_to_40 has all."""
    return rounded(statistics.autocorrelation(_returns(spark, sf), "ret", 20))


@query(f"""WITH {RETURNS}, k AS (SELECT symbol, ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL),
c AS (SELECT symbol, l, i // l AS c, i, x, avg(x) OVER (PARTITION BY symbol, l, i // l) AS mu FROM k, range(10, 61) t(l) WHERE l <= n // 4 AND (i // l + 1) * l <= n),
s AS (SELECT *, sum(x - mu) OVER (PARTITION BY symbol, l, c ORDER BY i ROWS UNBOUNDED PRECEDING) AS w FROM c),
rs AS (SELECT symbol, l, c, (max(w) - min(w)) / nullif(stddev_samp(x), 0) AS q FROM s GROUP BY ALL), a AS (SELECT symbol, ln(l) AS a, ln(avg(q)) AS b FROM rs WHERE q > 0 GROUP BY symbol, l)
SELECT symbol, CASE WHEN count(*) >= 3 THEN round(regr_slope(b, a), 5) END AS hurst, CASE WHEN count(*) >= 3 THEN round(regr_r2(b, a), 5) END AS r2 FROM a GROUP BY symbol""")
def hurst_exponent(spark: S, sf: str) -> D:
    """Chunk lengths up to 60 only, as in the SQL; hurst_all_lengths has all."""
    return rounded(statistics.hurst(_returns(spark, sf), "ret", most_lag=60), 5)


@query(f"""WITH {RETURNS}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS i FROM r WHERE ret IS NOT NULL), m AS (SELECT symbol, avg(ret) AS mu, var_pop(ret) AS v, count(*) AS n FROM k GROUP BY symbol)
SELECT a.symbol, CAST(l AS INTEGER) AS lag, round(sum((a.ret - mu) * (b.ret - mu)) / any_value(v * n), 6) + 0.0 AS acf FROM range(1, 41) t(l), k a JOIN k b ON a.symbol = b.symbol AND a.i = b.i + l JOIN m ON m.symbol = a.symbol GROUP BY ALL""")
def autocorrelation_to_40(spark: S, sf: str) -> D:
    """All the lags of the report: min(40, n - 1)."""
    return rounded(statistics.autocorrelation(_returns(spark, sf), "ret"))


@query(f"""WITH {RETURNS}, k AS (SELECT symbol, ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL),
e AS (SELECT *, unnest(range(10, n // 4 + 1)) AS l FROM k), c AS (SELECT symbol, l, i // l AS c, i, x, avg(x) OVER (PARTITION BY symbol, l, i // l) AS mu FROM e WHERE (i // l + 1) * l <= n),
s AS (SELECT *, sum(x - mu) OVER (PARTITION BY symbol, l, c ORDER BY i ROWS UNBOUNDED PRECEDING) AS w FROM c),
rs AS (SELECT symbol, l, c, (max(w) - min(w)) / nullif(stddev_samp(x), 0) AS q FROM s GROUP BY ALL), a AS (SELECT symbol, ln(l) AS a, ln(avg(q)) AS b FROM rs WHERE q > 0 GROUP BY symbol, l)
SELECT symbol, CASE WHEN count(*) >= 3 THEN round(regr_slope(b, a), 5) END AS hurst, CASE WHEN count(*) >= 3 THEN round(regr_r2(b, a), 5) END AS r2 FROM a GROUP BY symbol""")
def hurst_all_lengths(spark: S, sf: str) -> D:
    """Every chunk length from 10 to a quarter of the series."""
    return rounded(statistics.hurst(_returns(spark, sf), "ret"), 5)


# Factors.

_SMALL = Periods(rsi=(14,), change=(5, 20), volatility=(20,), bollinger=(20,), average=(20,), true_range=(14,), volume=(10,), aroon=(20,), money_flow=(14,), quality=(20,), sentiment=(5,), levels=(20,), macd_pairs=())
_FACTORS = ["momentum_roc_5", "return_vol_20", "close_high_20", "volume_ratio_10"]
_PANEL = f"""{RETURNS}, f AS (SELECT symbol, bar_date, close / lag(close, 5) OVER w - 1 AS momentum_roc_5, CASE WHEN count(ret) OVER {_rows(20)} = 20 THEN stddev_samp(ret) OVER {_rows(20)} END AS return_vol_20,
  CASE WHEN count(*) OVER {_rows(20)} = 20 THEN close / max(high) OVER {_rows(20)} END AS close_high_20, CASE WHEN count(*) OVER {_rows(10)} = 10 THEN volume / (avg(volume) OVER {_rows(10)} + 1e-10) END AS volume_ratio_10, lead(close, 5) OVER w / close - 1 AS forward FROM r {_W}),
u AS (SELECT symbol, bar_date, factor, value, forward FROM (SELECT symbol, bar_date, forward, unnest(['momentum_roc_5', 'return_vol_20', 'close_high_20', 'volume_ratio_10']) AS factor, unnest([momentum_roc_5, return_vol_20, close_high_20, volume_ratio_10]) AS value FROM f) WHERE value IS NOT NULL AND forward IS NOT NULL)"""


def _long(spark: S, sf: str, gaps: bool = False) -> D:
    """The four factors that have SQL."""
    rows = bars(spark, sf)
    panel = factor_panel(rows, _SMALL, with_python=False).select("symbol", "bar_date", *_FACTORS)
    forward = rows.select("symbol", "bar_date", (F.lead("close", 5).over(W()) / F.col("close") - 1).alias("forward"))
    return statistics.long_factors(panel.join(forward, ["symbol", "bar_date"]), _FACTORS, "forward", gaps=gaps)


@query(f"WITH {_PANEL} SELECT symbol, bar_date, factor, round(value, 6) + 0.0 AS value, round(forward, 6) + 0.0 AS forward FROM u")
def factor_values(spark: S, sf: str) -> D:
    return rounded(_long(spark, sf))


@query()
def factor_library(spark: S, sf: str) -> D:
    return factor_panel(bars(spark, sf), filled=True)


@query(f"""WITH {_PANEL}, k AS (SELECT factor, value, forward, rank() OVER (PARTITION BY factor ORDER BY value) + (count(*) OVER (PARTITION BY factor, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY factor ORDER BY forward) + (count(*) OVER (PARTITION BY factor, forward) - 1) / 2 AS rf FROM u)
SELECT factor, count(*) AS n, round(corr(value, forward), 5) + 0.0 AS ic, round(corr(rv, rf), 5) + 0.0 AS rank_ic FROM k GROUP BY factor""")
def information_coefficients(spark: S, sf: str) -> D:
    return rounded(statistics.information_coefficients(_long(spark, sf)), 5)


@query(f"""WITH {_PANEL}, g AS (SELECT symbol, forward, unnest(['momentum_roc_5', 'return_vol_20', 'close_high_20', 'volume_ratio_10']) AS factor, unnest([momentum_roc_5, return_vol_20, close_high_20, volume_ratio_10]) AS value,
  row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE forward IS NOT NULL),
x AS (SELECT factor, symbol, i + k AS t, value, forward FROM g, (SELECT unnest(range(20)) AS k) WHERE value IS NOT NULL AND i + k BETWEEN 20 AND n - 1),
k AS (SELECT *, rank() OVER (PARTITION BY factor, symbol, t ORDER BY value) + (count(*) OVER (PARTITION BY factor, symbol, t, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY factor, symbol, t ORDER BY forward) + (count(*) OVER (PARTITION BY factor, symbol, t, forward) - 1) / 2 AS rf FROM x),
w AS (SELECT factor, symbol, t, CASE WHEN min(value) < max(value) AND min(forward) < max(forward) THEN corr(value, forward) END AS ic, CASE WHEN min(value) < max(value) AND min(forward) < max(forward) THEN corr(rv, rf) END AS rank_ic FROM k GROUP BY ALL HAVING count(*) >= 10)
SELECT factor, {', '.join(f'round(avg({c}), 4) + 0.0 AS {c}_mean, round(stddev_samp({c}), 4) + 0.0 AS {c}_std, round(avg({c}) / (stddev_samp({c}) + 1e-10), 4) + 0.0 AS {c}_ir' for c in ('ic', 'rank_ic'))} FROM w GROUP BY factor""")
def rolling_ic(spark: S, sf: str) -> D:
    return rounded(statistics.rolling_ic(_long(spark, sf, gaps=True)), 4)


@query(f"""WITH {_PANEL}, e AS (SELECT factor, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS e FROM u GROUP BY factor), g AS (SELECT factor, forward, len(list_filter(e, lambda x: x <= value)) + 1 AS b FROM u JOIN e USING (factor))
SELECT factor, {', '.join(f'round(avg(forward) FILTER (b = {i}), 5) + 0.0 AS group_{i}' for i in range(1, 6))}, round(avg(forward) FILTER (b = 5) - avg(forward) FILTER (b = 1), 5) + 0.0 AS long_short FROM g GROUP BY factor""")
def group_returns(spark: S, sf: str) -> D:
    return rounded(statistics.group_returns(_long(spark, sf)), 5)


@query(f"""WITH {_PANEL}, p AS (SELECT symbol, bar_date, factor, value, quantile_cont(value, 0.8) OVER (PARTITION BY symbol, bar_date) AS edge FROM (SELECT symbol, bar_date, unnest(['momentum_roc_5', 'return_vol_20', 'close_high_20', 'volume_ratio_10']) AS factor, unnest([momentum_roc_5, return_vol_20, close_high_20, volume_ratio_10]) AS value FROM f)),
t AS (SELECT symbol, bar_date, coalesce(list(factor) FILTER (value >= edge), []) AS top FROM p GROUP BY ALL), b AS (SELECT *, lag(top) OVER (PARTITION BY symbol ORDER BY bar_date) AS before FROM t)
SELECT symbol, bar_date, round(1 - len(list_intersect(top, before)) / (len(list_distinct(list_concat(top, before))) + 1e-10), 6) + 0.0 AS turnover FROM b WHERE before IS NOT NULL""")
def turnover_of_four(spark: S, sf: str) -> D:
    """Turnover among the factors that have SQL."""
    return rounded(statistics.factor_turnover(factor_panel(bars(spark, sf), _SMALL, with_python=False), _FACTORS))


@query()
def factor_turnover(spark: S, sf: str) -> D:
    panel = factor_panel(bars(spark, sf))
    return statistics.factor_turnover(panel, [c for c in panel.columns if c not in ("symbol", "bar_date", "close")])


# The reports over every factor of the library.  The queries above are the part of them that has SQL.


def _long_all(spark: S, sf: str, gaps: bool = False) -> D:
    rows = bars(spark, sf)
    panel = factor_panel(rows).drop("close")
    factors = [c for c in panel.columns if c not in ("symbol", "bar_date")]
    forward = rows.select("symbol", "bar_date", (F.lead("close", 5).over(W()) / F.col("close") - 1).alias("forward"))
    return statistics.long_factors(panel.join(forward, ["symbol", "bar_date"]), factors, "forward", gaps=gaps)


@query()
def factor_values_all(spark: S, sf: str) -> D:
    return rounded(_long_all(spark, sf))


@query()
def information_coefficients_all(spark: S, sf: str) -> D:
    return rounded(statistics.information_coefficients(_long_all(spark, sf)), 5)


@query()
def rolling_ic_all(spark: S, sf: str) -> D:
    return rounded(statistics.rolling_ic(_long_all(spark, sf, gaps=True)), 4)


@query()
def group_returns_all(spark: S, sf: str) -> D:
    return rounded(statistics.group_returns(_long_all(spark, sf)), 5)


# Monitoring.


def _records(spark: S, sf: str) -> D:
    return market.outcome_after(predictions(spark, sf), bars(spark, sf), AS_OF)


_STATUS = f"""{OUTCOMES}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY predict_date DESC) AS k FROM acc), st AS (
  SELECT symbol, count(*) AS n, avg(error_magnitude) AS mae, sqrt(avg(error_magnitude ** 2)) AS rmse, avg(direction_correct) AS da, avg(error_magnitude) FILTER (k <= 20) AS rm, min(error_magnitude) FILTER (k <= 5) AS l5, max(predict_date) AS last_date FROM b GROUP BY symbol)"""


@query(f"WITH {_STATUS} SELECT symbol, n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(da, 5) AS direction_accuracy, round(rm, 5) AS recent_mae, last_date, rm > 1.5 * mae AS decayed FROM st")
def accuracy_status(spark: S, sf: str) -> D:
    return rounded(monitoring.decay(monitoring.accuracy_status(_records(spark, sf))).drop("_least_of_5"), 5)


@query(f"""WITH {_STATUS}, q AS (SELECT *, symbol = '5-LOW' AS fl, CASE symbol WHEN '1-URGENT' THEN DATE '{AS_OF}' - 3 WHEN '2-HIGH' THEN DATE '{AS_OF}' - 40 END AS tr FROM st)
SELECT symbol, unnest(list_filter([CASE WHEN rm > 1.5 * mae THEN 'performance_decay' END, CASE WHEN coalesce(DATE '{AS_OF}' - tr >= 30, TRUE) THEN 'stale_model' END, CASE WHEN da < 0.5 THEN 'low_accuracy' END, CASE WHEN n >= 5 AND l5 > 1.5 * mae THEN 'consecutive_errors' END, CASE WHEN fl THEN 'training_failures' END], lambda x: x IS NOT NULL)) AS alert FROM q""")
def alerts(spark: S, sf: str) -> D:
    day = F.lit(AS_OF).cast("date")
    runs = spark.createDataFrame([("1-URGENT", 3), ("2-HIGH", 40)], "symbol string, ago int").select("symbol", F.date_sub(day, F.col("ago")).alias("trained_at"))
    failures = spark.createDataFrame([("5-LOW",)] * 3 + [("1-URGENT",)], "symbol string")
    return monitoring.alerts(monitoring.accuracy_status(_records(spark, sf)), runs, failures, AS_OF)


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, isodow(day) = 5 AS weekly, day = CAST(last_day(day) - greatest(isodow(last_day(day)) - 5, 0)::INTEGER AS DATE) AS monthly,
  day = CAST(last_day(day) - greatest(isodow(last_day(day)) - 5, 0)::INTEGER AS DATE) AND month(day) % 3 = 0 AS quarterly, FALSE AS decay FROM d""")
def retraining_triggers(spark: S, sf: str) -> D:
    return monitoring.triggers(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct())


@query("SELECT p_partkey, p_retailprice % 1 - p_size % 10 / 10 >= 0.05 OR p_size <= 0.9 * (p_retailprice % 50) AS deploy FROM part")
def deploy_gate(spark: S, sf: str) -> D:
    parts = table(spark, sf, "part")
    gate = monitoring.should_deploy(F.col("p_retailprice") % 1, F.col("p_size") % 10 / 10, F.col("p_size").cast("double"), F.col("p_retailprice") % 50 * 1.0)
    return parts.select("p_partkey", gate.alias("deploy"))


@query(f"""WITH {BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS k FROM bars), e AS (SELECT symbol, max(bar_date) AS predict_date, max_by(close, bar_date) / min_by(close, bar_date) - 1 AS m FROM b WHERE k <= 5 GROUP BY symbol)
SELECT symbol, predict_date, round(m, 6) + 0.0 AS move, CASE WHEN m > 0.02 THEN 'up' WHEN m < -0.02 THEN 'down' ELSE 'flat' END AS trend FROM e""")
def trend_prediction(spark: S, sf: str) -> D:
    return rounded(monitoring.trend_prediction(bars(spark, sf)))


@query(f"""WITH RECURSIVE {BARS}, k AS (SELECT symbol, bar_date, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS i FROM bars),
e AS (SELECT symbol, bar_date, i, close AS f, close AS s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, close, 0.0::DOUBLE AS sig FROM k WHERE i = 1
  UNION ALL SELECT k.symbol, k.bar_date, k.i, e.f + (k.close - e.f) * 2 / 13, e.s + (k.close - e.s) * 2 / 27, e.g + (greatest(k.close - e.close, 0) - e.g) / 14, e.l + (greatest(e.close - k.close, 0) - e.l) / 14, k.close,
    e.sig + ((e.f + (k.close - e.f) * 2 / 13) - (e.s + (k.close - e.s) * 2 / 27) - e.sig) * 2 / 10 FROM e JOIN k ON k.symbol = e.symbol AND k.i = e.i + 1),
t AS (SELECT symbol, max(bar_date) AS predict_date, max_by(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) END, i) AS rsi, max_by(f - s - sig, i) AS hist FROM e GROUP BY symbol),
r AS (SELECT symbol, bar_date, close / lag(close) OVER w - 1 AS ret FROM bars {_W}), v AS (SELECT symbol, max_by(sd, bar_date) AS vol FROM (SELECT symbol, bar_date, CASE WHEN count(ret) OVER {_rows(20)} = 20 THEN stddev_samp(ret) OVER {_rows(20)} END AS sd FROM r) GROUP BY symbol),
d AS (SELECT *, CASE WHEN rsi < 35 THEN TRUE WHEN rsi > 65 THEN FALSE ELSE coalesce(hist > 0, FALSE) END AS up, least(coalesce(vol, 0) * sqrt(5), 0.15) AS size FROM t JOIN v USING (symbol))
SELECT symbol, predict_date, CAST(up AS INTEGER) AS direction, round(CASE WHEN up THEN size ELSE -size END, 6) + 0.0 AS magnitude, 'technical' AS source FROM d""")
def fallback_prediction(spark: S, sf: str) -> D:
    rows = with_recurrences(bars(spark, sf)).join(_returns(spark, sf).select("symbol", "bar_date", series.deviation("ret", W(), 20).alias("vol20")), ["symbol", "bar_date"])
    return rounded(monitoring.fallback_prediction(rows))


@query(f"""WITH {BARS}, a AS (SELECT symbol, bar_date, list(high) OVER x AS h, list(low) OVER x AS l FROM bars WINDOW x AS {_rows(20)}),
b AS (SELECT symbol, max_by(list_position(h, list_max(h)) * 5.0, bar_date) AS u, max_by(list_position(l, list_min(l)) * 5.0, bar_date) AS d FROM a GROUP BY symbol)
SELECT symbol, CASE WHEN u >= 70 AND d <= 30 THEN '强势' WHEN d >= 70 AND u <= 30 THEN '弱势' WHEN u > d THEN '偏多' ELSE '偏空' END AS aroon_signal FROM b""")
def overbought_signals(spark: S, sf: str) -> D:
    rows = bars(spark, sf).select("symbol", "bar_date", series.aroon("high", W(), 20, True).alias("up"), series.aroon("low", W(), 20, False).alias("down"))
    now = rows.groupBy("symbol").agg(F.max_by(F.struct("up", "down"), "bar_date").alias("s"))
    found = series.overbought_signals(F.lit(50.0), F.lit(50.0), F.col("s.up"), F.col("s.down"))
    return now.select("symbol", found["aroon_signal"].alias("aroon_signal"))
