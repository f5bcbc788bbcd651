"""Queries of the numeric kernels, of the models and of the streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arima, explain, kernels, ml, series
from ..operators.factors import factor_panel
from ..operators.recurrence import with_recurrences
from ..scratch import scratch_folder, written
from ..streaming import events
from .inputs import RETURNS, bars, rounded, table
from .registry import query

S, D = SparkSession, DataFrame


def _returns(spark: S, sf: str) -> D:
    return series.with_returns(bars(spark, sf))


def _rounded7(df: D) -> D:
    return rounded(df, 7)


_X = f"{RETURNS}, x AS (SELECT symbol, ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL)"


@query(f"""WITH {_X}, z AS (SELECT symbol, n, least(greatest(least(n // 4, 256), 8), n) AS m FROM x GROUP BY ALL), seg AS (SELECT symbol, m, unnest(range(0, n - m + 1, m - m // 2)) AS b FROM z),
p AS (SELECT seg.symbol, b, m, i - b AS j, x FROM seg JOIN x ON x.symbol = seg.symbol AND i >= b AND i < b + m), l AS (SELECT symbol, b, avg(x) AS mx, regr_slope(x, j) AS sl FROM p GROUP BY ALL),
t AS (SELECT p.*, (x - mx - sl * (j - (m - 1) / 2)) * (0.5 - 0.5 * cos(2 * pi() * j / m)) AS y, (0.5 - 0.5 * cos(2 * pi() * j / m)) ** 2 AS h FROM p JOIN l USING (symbol, b)),
f AS (SELECT symbol, b, k, m, (sum(y * cos(2 * pi() * ((k * j) % m) / m)) ** 2 + sum(y * sin(2 * pi() * ((k * j) % m) / m)) ** 2) / sum(h) * CASE WHEN 2 * k = m THEN 1 ELSE 2 END AS power FROM (SELECT *, unnest(range(1, m // 2 + 1)) AS k FROM t) GROUP BY symbol, b, k, m),
a AS (SELECT symbol, k, m / k AS period, avg(power) AS power FROM f WHERE m / k >= 5 GROUP BY ALL)
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY power DESC, k) AS INTEGER) AS rank, round(period, 7) AS period, round(power, 7) + 0.0 AS power, round(power / sum(power) OVER (PARTITION BY symbol), 7) + 0.0 AS share FROM a QUALIFY rank <= 5""")
def welch_periods(spark: S, sf: str) -> D:
    return _rounded7(kernels.by_key(_returns(spark, sf), lambda x: kernels.dominant_periods(*kernels.welch(x), top=5, least=5.0), "rank int, period double, power double, share double", "ret"))


@query(f"""WITH {_X}, m AS (SELECT symbol, avg(x) AS mu FROM x GROUP BY symbol), y AS (SELECT symbol, i, n, (x - mu) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM x JOIN m USING (symbol)),
f AS (SELECT symbol, k, n / k AS period, 2 / any_value(n) * sqrt(sum(y * cos(2 * pi() * ((k * i) % n) / n)) ** 2 + sum(y * sin(2 * pi() * ((k * i) % n) / n)) ** 2) AS power FROM (SELECT *, unnest(range(1, (n - 1) // 2 + 1)) AS k FROM y) GROUP BY symbol, k, n)
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY power DESC, k) AS INTEGER) AS rank, round(period, 7) AS period, round(power, 7) + 0.0 AS power, round(power / sum(power) OVER (PARTITION BY symbol), 7) + 0.0 AS share FROM f QUALIFY rank <= 3""")
def fft_periods(spark: S, sf: str) -> D:
    return _rounded7(kernels.by_key(_returns(spark, sf), lambda x: kernels.dominant_periods(*kernels.fft_spectrum(x)), "rank int, period double, power double, share double", "ret"))


@query(f"""WITH {_X}, m AS (SELECT symbol, n, avg(x) AS mu, list(x ORDER BY i) AS xs FROM x GROUP BY symbol, n), pad AS (SELECT symbol, n, least(100, n // 2) AS top, list_concat(list_concat([0.0::DOUBLE for q in range(400)], [v - mu for v in xs]), [0.0::DOUBLE for q in range(400)]) AS p FROM m),
w AS (SELECT s, [exp(-((u / s) ** 2) / 2) * cos(5 * u / s) / sqrt(s) for u in range(-4 * s, 4 * s + 1)] AS wave FROM (SELECT unnest(range(2, 100)) AS s))
SELECT symbol, CAST(s AS INTEGER) AS scale, round(avg(c ** 2), 7) + 0.0 AS power FROM (SELECT symbol, s, list_dot_product(list_slice(p, i + 401 - 4 * s, i + 401 + 4 * s), wave) AS c FROM (SELECT *, unnest(range(n)) AS i FROM pad JOIN w ON s < greatest(3, top))) GROUP BY symbol, s""")
def wavelet_power(spark: S, sf: str) -> D:
    def power(x: np.ndarray) -> list[tuple]:
        scales, c = kernels.morlet(x)
        return [(int(s), float(p)) for s, p in zip(scales, (c**2).mean(axis=1), strict=True)]

    return _rounded7(kernels.by_key(_returns(spark, sf), power, "scale int, power double", "ret"))


@query()
def stl_parts(spark: S, sf: str) -> D:
    def parts(x: np.ndarray) -> list[tuple]:
        found = kernels.stl(x)
        return [] if found is None else [(i, *map(float, row)) for i, row in enumerate(zip(*found, strict=True))]

    return kernels.by_key(bars(spark, sf), parts, "i int, trend double, season double, remainder double", "close")


@query()
def adf_test(spark: S, sf: str) -> D:
    """Of the returns of every symbol, and of its closes with a trend."""
    kind = "statistic double, p_value double, lags int, observations int, at_1 double, at_5 double, at_10 double"
    returns = kernels.by_key(_returns(spark, sf), lambda x: [arima.adf(x)], kind, "ret").withColumn("series", F.lit("returns"))
    closes = kernels.by_key(bars(spark, sf), lambda x: [arima.adf(x, "ct")], kind, "close").withColumn("series", F.lit("closes"))
    return returns.unionByName(closes).withColumn("stationary", F.col("p_value") < 0.05)


@query()
def arima_forecast(spark: S, sf: str) -> D:
    return arima.forecast_by_key(bars(spark, sf), "close")


@query()
def dtw_between_symbols(spark: S, sf: str) -> D:
    """The whole series of every two symbols warped onto each other: n (n - 1) / 2 pairs of n symbols, left below right."""
    curves = bars(spark, sf).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("bar_date", "close"))), lambda r: r["close"]).alias("curve"))
    pairs = curves.alias("a").join(curves.alias("b"), F.col("a.symbol") < F.col("b.symbol")).select(F.col("a.symbol").alias("left_symbol"), F.col("b.symbol").alias("right_symbol"), F.col("a.curve").alias("x"), F.col("b.curve").alias("y"))
    pairs = pairs.repartition("left_symbol", "right_symbol")

    @F.pandas_udf("struct<distance:double,steps:int,normalised:double>")
    def distance(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [kernels.dtw(kernels.normalised(np.asarray(a)), kernels.normalised(np.asarray(b))) for a, b in zip(x, y, strict=True)]
        return pd.DataFrame([(d, n, d / max(n, 1)) for d, n in found], columns=["distance", "steps", "normalised"])

    return pairs.select("left_symbol", "right_symbol", distance("x", "y").alias("d")).select("left_symbol", "right_symbol", "d.*")


@query()
def similar_patterns(spark: S, sf: str) -> D:
    """Where each symbol's last 20 closes have occurred before, at any offset of its whole history."""
    return kernels.by_key(bars(spark, sf), lambda x: kernels.similar_patterns(x[-20:], x[:-20]), "rank int, begin int, distance double", "close")


@query(f"""WITH {_X}, t AS (SELECT symbol, i, n, x AS a, lead(x) OVER k AS b, lead(x, 2) OVER k AS c, 0.2 * stddev_pop(x) OVER (PARTITION BY symbol) AS tol FROM x WINDOW k AS (PARTITION BY symbol ORDER BY i)),
g AS (SELECT p.symbol, p.i, p.n, p.tol, q.i AS j, greatest(abs(p.a - q.a), abs(p.b - q.b)) AS d2, CASE WHEN p.c IS NOT NULL AND q.c IS NOT NULL THEN greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)) END AS d3 FROM t p JOIN t q ON p.symbol = q.symbol AND p.b IS NOT NULL AND q.b IS NOT NULL),
c AS (SELECT symbol, i, n, count(*) FILTER (d2 <= tol) AS c2, count(*) FILTER (d3 <= tol) AS c3, count(*) FILTER (d2 < tol AND i < n - 2 AND j < n - 2 AND i <> j) AS b, count(*) FILTER (d3 < tol AND i < n - 3 AND j < n - 3 AND i <> j) AS a FROM g GROUP BY ALL)
SELECT symbol, round(-ln(sum(a) / sum(b)), 7) + 0.0 AS sample_entropy, round(avg(ln(c2 / (n - 1))) - avg(ln(c3 / (n - 2))) FILTER (c3 > 0), 7) + 0.0 AS approximate_entropy FROM c GROUP BY symbol""")
def entropies(spark: S, sf: str) -> D:
    return _rounded7(kernels.by_key(_returns(spark, sf), lambda x: [(kernels.sample_entropy(x), kernels.approximate_entropy(x))], "sample_entropy double, approximate_entropy double", "ret"))


@query()
def ensemble_holdout(spark: S, sf: str) -> D:
    """Forest and boosted trees over the factor library on a chronological split; metrics of the later rows.

    Factors are eliminated (by forests of 10 trees, half of the factors at a time), rounds stopped
    (on the last fifth of the training days) and models weighted on training rows only.  The panel
    is written once and read by every model.
    """
    rows = bars(spark, sf)
    panel = written(ml.labelled_panel(factor_panel(rows).drop("close"), rows), "factor-panel")
    train, test = ml.chronological_split(panel)
    features = ml.eliminate(train, [c for c in panel.columns if c not in ("symbol", "bar_date", "forward", "label")], keep=15, step=0.5, n=2, trees=10, depth=4)
    early, late = ml.chronological_split(train, 0.8)
    marked = early.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    models = {"p_rf": ml.train_forest(train, features, trees=30), "p_gb": ml.train_boosted(marked, features, rounds=10, validation="late")}
    fitted = train
    for name, m in models.items():
        fitted, test = ml.probabilities(m, fitted, features, name), ml.probabilities(m, test, features, name)
    weights, _ = ml.best_weights(fitted, list(models))
    return ml.holdout_metrics(test.withColumn("p", ml.weighted(list(models), weights)))


@query()
def shapley_importance(spark: S, sf: str) -> D:
    """Which factors move a forest's probabilities on the later rows: mean Shapley values of every factor of the library."""
    rows = bars(spark, sf)
    panel = written(ml.labelled_panel(factor_panel(rows).drop("close"), rows), "factor-panel")
    train, test = ml.chronological_split(panel)
    features = [c for c in panel.columns if c not in ("symbol", "bar_date", "forward", "label")]
    return explain.importance(ml.train_forest(train, features, trees=20, depth=6), test, features)


@query()
def ensemble_weights(spark: S, sf: str) -> D:
    """Weights of three plain forecasts of the next close's direction: oscillator, trend, and even odds."""
    w = series.window("symbol", "bar_date")
    rows = bars(spark, sf).withColumn("label", (F.lead("close").over(w) > F.col("close")).cast("double")).select("symbol", "bar_date", "label")
    told = with_recurrences(bars(spark, sf)).join(rows, ["symbol", "bar_date"])
    forecasts = {"oscillator": 1 - F.col("rsi_14") / 100, "trend": F.when(F.col("macd_hist") > 0, 0.6).otherwise(0.4), "even": F.lit(0.5)}
    weights, loss = ml.simplex_weights(written(told.select("label", *[c.alias(n) for n, c in forecasts.items()]), "forecasts"), list(forecasts))
    return spark.createDataFrame([(n, x, loss) for n, x in zip(forecasts, weights, strict=True)], "forecast string, weight double, loss double")


_WINDOWS = """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL"""


def _ntz(df: D) -> D:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query(_WINDOWS)
def window_counts(spark: S, sf: str) -> D:
    """The batch twin of stream_window_counts."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(_ntz(events.window_counts(e)), 4)


@query(_WINDOWS)
def stream_window_counts(spark: S, sf: str) -> D:
    """Deduplicated events in hourly windows by a stream in update mode, whose keyed sink is read back."""
    base = scratch_folder(spark, "stream")
    stream = events.window_counts(events.once(events.read_events(spark, sf, "events.parquet"), "40 days"), late=None)
    keys = ["window_start", "window_end", "event_type"]
    q = stream.writeStream.outputMode("update").foreachBatch(events.upsert_sink(f"{base}/out", keys)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    found = events.latest(spark, f"{base}/out", "window_start timestamp, window_end timestamp, event_type string, n long, total double", keys)
    return rounded(_ntz(found), 4)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM k GROUP BY user_id, i""")
def user_sessions(spark: S, sf: str) -> D:
    return _ntz(events.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
