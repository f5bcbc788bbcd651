"""Recurrences by stretches against the loop over a whole series."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlattice.operators import recurrence

DAY = datetime.date(2000, 1, 1)
WHAT = {"emas": (5, 60), "rsis": (14, 3), "macds": ((12, 26, 9), (3, 7, 4))}


def same(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0 and a[keys].equals(b[keys])
    for c in a.columns.difference(keys):
        x, y = a[c].to_numpy(float), b[c].to_numpy(float)
        assert np.array_equal(np.isnan(x), np.isnan(y)) and np.allclose(x, y, rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_stretches_give_the_numbers_of_the_whole(spark, parts):
    r = np.random.default_rng(parts)
    rows = [(k, DAY + datetime.timedelta(days=i), float(v)) for k, n in (("a", 300), ("b", 1), ("c", 2), ("flat", 40), ("d", 77)) for i, v in enumerate(np.full(n, 5.0) if k == "flat" else 100 + np.cumsum(r.standard_normal(n)))]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, close double").repartition(7)
    same(recurrence.spread_recurrences(df, parts=parts, **WHAT), recurrence.with_recurrences(df, **WHAT), ["symbol", "bar_date"])


def test_one_long_history_is_spread_over_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("symbol"), F.col("id").alias("bar_date"), (100 + 10 * F.sin(F.col("id") / 50) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 500).alias("close"))
    made = recurrence.spread_recurrences(df, emas=(20,), parts=16).withColumn("part", F.spark_partition_id())
    got = made.toPandas().sort_values("bar_date")
    x = df.toPandas().sort_values("bar_date").close.to_numpy()
    assert np.allclose(got.ema_20, recurrence.ema(x, 2 / 21), rtol=1e-9) and np.allclose(got.rsi_14, recurrence.rsi(x), rtol=1e-9, equal_nan=True)
    for name, want in zip(("macd", "macd_signal", "macd_hist"), recurrence.macd(x), strict=True):
        assert np.allclose(got[name], want, rtol=1e-9, atol=1e-9)
    assert len(got) == n and got.part.nunique() > 1


def test_gaps_and_names(spark):
    rows = [("a", 1, 1.0, "x"), ("a", 2, None, "x"), ("a", 3, float("nan"), "x"), ("a", 4, 2.0, "x"), ("a", None, 9.0, "x"), (None, 1, 3.0, "x")]
    df = spark.createDataFrame(rows, "symbol string, bar_date int, close double, _stretch string")
    got = recurrence.spread_recurrences(df, emas=(3,), rsis=(), macds=(), parts=2).orderBy("symbol", "bar_date").collect()
    assert [tuple(r) for r in got] == [(None, 1, 3.0), ("a", 1, 1.0), ("a", 4, 1.5)]
    assert recurrence.spread_recurrences(df.limit(0), parts=2).count() == 0
