"""Registered queries do the whole job: small fixtures on which a cut shows."""

import datetime
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registry
from finlattice.operators import arima, factors, kernels, ml
from finlattice.plans import inputs
from finlattice.plans import kernels as plans

DAYS = 450
SYMBOLS = ["1-URGENT", "3-MEDIUM", "5-LOW"]
random = np.random.default_rng(7)
CLOSES = {s: 100 + np.abs(np.cumsum(random.standard_normal(DAYS))) for s in SYMBOLS}
for closes in CLOSES.values():
    closes[3:23] = closes[-20:]  # before the last 400, and at no fifth offset


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with one order a symbol and day."""
    folder = str(tmp_path_factory.mktemp("sf"))
    start = datetime.datetime(1995, 1, 2)
    rows = [(i * 10 + k, s, start + datetime.timedelta(days=i), float(CLOSES[s][i])) for k, s in enumerate(SYMBOLS) for i in range(DAYS)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    return folder


def run(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def test_stl_has_a_row_for_every_bar(spark, sf):
    got = run(spark, sf, "stl_parts")
    assert len(got) == DAYS * len(SYMBOLS)
    for s in SYMBOLS:
        parts = sorted((r.i, r.trend + r.season + r.remainder) for r in got if r.symbol == s)
        assert [i for i, _ in parts] == list(range(DAYS)) and np.allclose([x for _, x in parts], CLOSES[s])


def test_arima_fits_the_whole_series(spark, sf):
    got = run(spark, sf, "arima_forecast")
    for s in SYMBOLS:
        mine = sorted((r.step, r.forecast, r.lower, r.upper, r.p, r.d, r.q, r.aic) for r in got if r.symbol == s)
        assert mine == [pytest.approx(x, rel=1e-6) for x in arima.arima(CLOSES[s])]  # the grid one after the other


def test_patterns_are_found_in_the_whole_history(spark, sf):
    best = {r.symbol: (r.begin, r.distance) for r in run(spark, sf, "similar_patterns") if r.rank == 1}
    assert best == {s: (3, 0.0) for s in SYMBOLS}


def test_every_two_symbols_are_warped_whole(spark, sf):
    got = {(r.left_symbol, r.right_symbol): (r.distance, r.steps) for r in run(spark, sf, "dtw_between_symbols")}
    assert sorted(got) == [("1-URGENT", "3-MEDIUM"), ("1-URGENT", "5-LOW"), ("3-MEDIUM", "5-LOW")]
    for (a, b), (distance, steps) in got.items():
        want = kernels.dtw(kernels.normalised(CLOSES[a]), kernels.normalised(CLOSES[b]))
        assert distance == pytest.approx(want[0]) and steps == want[1] >= DAYS


def test_fast_kernels_by_plain_loops():
    a, b = random.standard_normal(17), random.standard_normal(23)
    for band in (None, 6, 9, 3):
        cost = np.full((18, 24), np.inf)
        cost[0, 0] = 0
        for i in range(1, 18):
            for j in range(1, 24):
                if band is None or abs(i - j) <= band:
                    cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
        assert kernels.dtw(a, b, band)[0] == cost[17, 23]
    assert kernels.dtw(a, b, 3) == (math.inf, 0)
    for n, width in ((40, 11), (5, 7), (30, 7)):
        y, weights = random.standard_normal(n), random.random(n)
        for i, got in enumerate(kernels._loess(y, width, weights)):
            first = min(max(0, i - min(width, n) // 2), max(0, n - width))
            t = np.arange(first, min(n, first + width)) - i
            w = (1 - (np.abs(t) / (np.abs(t).max() + 1)) ** 3) ** 3 * weights[t + i]
            assert got == pytest.approx(np.polyfit(t, y[t + i], 1, w=np.sqrt(w))[1])


def test_hurst_and_autocorrelation_use_every_lag(spark, sf):
    found = {r.symbol: r for r in run(spark, sf, "hurst_all_lengths")}
    acf = {(r.symbol, r.lag): r.acf for r in run(spark, sf, "autocorrelation_to_40")}
    assert len(acf) == 40 * len(SYMBOLS)
    for s in SYMBOLS:
        x = np.diff(CLOSES[s]) / CLOSES[s][:-1]
        n, points = len(x), []
        for lag in range(10, n // 4 + 1):
            chunks = x[: n // lag * lag].reshape(-1, lag)
            walk = np.cumsum(chunks - chunks.mean(axis=1, keepdims=True), axis=1)
            points.append((math.log(lag), math.log(((walk.max(axis=1) - walk.min(axis=1)) / chunks.std(axis=1, ddof=1)).mean())))
        a, b = np.array(points).T
        assert found[s].hurst == pytest.approx(np.polyfit(a, b, 1)[0], abs=2e-5) and found[s].r2 == pytest.approx(np.corrcoef(a, b)[0, 1] ** 2, abs=2e-5)
        d = x - x.mean()
        for lag in (1, 20, 21, 40):
            assert acf[s, lag] == pytest.approx((d[lag:] * d[:-lag]).sum() / (d * d).sum(), abs=2e-6)


def test_reports_cover_every_factor(spark, sf):
    every = {f for names in factors.catalogue().values() for f in names}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet/*.parquet'")
    for name in ("information_coefficients", "rolling_ic", "group_returns"):
        got = registry.queries()[f"{name}_all"](spark, sf)
        rows = {r.factor: r for r in got.collect()}
        assert len(every) > 190 and set(rows) == every
        columns = [c for c in got.columns if c != "factor"]
        for factor, *values in duck.sql(f"SELECT factor, {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall():
            values = [None if v != v else v for v in values]  # the correlation with a constant, as this fixture's volume is
            assert [rows[factor][c] for c in columns] == pytest.approx(values, abs=2e-4)


def test_turnover_ranks_every_factor(spark, sf):
    panel = factors.factor_panel(inputs.bars(spark, sf)).where("symbol = '5-LOW'").orderBy("bar_date").toPandas()
    names = [c for c in panel.columns if c not in ("symbol", "bar_date", "close")]
    tops = []
    for _, row in panel[names].iterrows():
        edge = np.nanpercentile(row.to_numpy(float), 80)
        tops.append({f for f, v in row.items() if v >= edge})
    want = [1 - len(a & b) / (len(a | b) + 1e-10) for a, b in zip(tops, tops[1:])]
    got = [r.turnover for r in sorted(run(spark, sf, "factor_turnover"), key=lambda r: r.bar_date) if r.symbol == "5-LOW"]
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(days=i), *map(float, x), float(x[0] + x[1] > 0)) for i, x in enumerate(rng.standard_normal((240, 6)))]
    return spark.createDataFrame(rows, "bar_date date, a double, b double, c double, d double, e double, f double, label double").coalesce(1).persist()


def test_elimination_and_stacking(labelled):
    found = ml.eliminate(labelled, list("abcdef"), keep=2, step=0.4, trees=10, depth=3)
    assert {"a", "b"} <= set(found)
    meta, bases, names = ml.stack(labelled, [lambda d, f: ml.train_forest(d, f, 10, 3), lambda d, f: ml.train_boosted(d, f, 3, 2)], ["a", "b"], n=2)
    out = labelled
    for model, name in zip(bases, names, strict=True):
        out = ml.probabilities(model, out, ["a", "b"], name)
    assert ml.auc(ml.probabilities(meta, out, names, "p"), "p").first()[0] > 0.9


def test_the_ensemble_gets_the_whole_library(spark, sf, monkeypatch):
    seen = {}

    def eliminate(train, features, **how):
        seen.update(features=features, how=how, last=train.agg({"bar_date": "max"}).first()[0])
        return features[:3]

    def forest(train, features, *given, make=ml.train_forest, **how):
        seen["forest"] = given, how
        return make(train, features, 3, 2)

    def boosted(train, features, *given, make=ml.train_boosted, **how):
        seen["boosted"] = given, how
        seen["late"] = {r.late: r.n for r in train.groupBy("late").count().withColumnRenamed("count", "n").collect()}
        return make(train, features, 2, 2, validation=how["validation"])

    for name, f in (("eliminate", eliminate), ("train_forest", forest), ("train_boosted", boosted)):
        monkeypatch.setattr(plans.ml, name, f)
    assert run(spark, sf, "ensemble_holdout")[0].mse is not None
    assert set(seen["features"]) == {f for names in factors.catalogue().values() for f in names} and seen["how"]["keep"] == 15
    assert seen["forest"] == ((), {"trees": 30}) and seen["boosted"] == ((), {"rounds": 10, "validation": "late"}) and all(seen["late"][x] > 0 for x in (True, False))
