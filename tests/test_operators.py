"""Edge cases of operators: nulls, ties, empty tables, defaults."""

import datetime

import pytest
from pyspark.sql import functions as F

from finlattice.functions import scalar
from finlattice.operators import market, ml, monitoring, scan, series, statistics, text
from finlattice.sources import readers, sinks

DAY = datetime.date(2024, 1, 31)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scalars(spark):
    df = spark.createDataFrame([("1.5", "20240131"), ("x", "2024-01-31 00:00:00"), (None, None), ("NaN", "bad")], "n string, d string")
    assert rows(df.select(scalar.safe_double(F.col("n")), scalar.safe_date(F.col("d")))) == rows(spark.createDataFrame([(1.5, DAY), (None, DAY), (None, None), (None, None)], "a double, b date"))
    got = spark.range(1).select(scalar.has_tag(F.lit('["a","b"]'), "a"), scalar.has_tag(F.lit("none"), "a"), scalar.is_hk_share(F.lit("00700.HK")), scalar.is_a_share(F.lit("600000"))).first()
    assert tuple(got) == (True, False, True, True)
    five = spark.range(1).select(scalar.business_days(F.lit("2024-01-31").cast("date"), 5)).first()[0]
    assert len(five) == 5 and all(d.weekday() < 5 for d in five) and five[0] == datetime.date(2024, 2, 1)
    end, start = scalar.clamp_dates(F.lit(None).cast("date"), F.lit("2030-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    assert tuple(spark.range(1).select(end, start).first()) == (datetime.date(2023, 1, 31), DAY)


def test_upserts_with_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, None), (None, "m"), (2, "b")], "k int, v string")
    assert rows(sinks.upsert(old, new, ["k"])) == rows(spark.createDataFrame([(1, None), (None, "m"), (2, "b")], "k int, v string"))
    assert rows(sinks.upsert(old, new, ["k"], coalesce=True)) == rows(spark.createDataFrame([(1, "a"), (None, "m"), (2, "b")], "k int, v string"))
    assert rows(sinks.upsert(old, new.limit(0), ["k"])) == rows(old)
    assert rows(sinks.replace_by_key(old, new.where("k = 1"), ["k"])) == rows(spark.createDataFrame([(1, None), (None, "n")], "k int, v string"))


def test_insert_ignore_takes_the_first_of_a_batch(spark):
    old = spark.createDataFrame([("u1", "x")], "url string, t string")
    new = spark.createDataFrame([("u2", "b", 2), ("u2", "a", 1), ("u1", "c", 3)], "url string, t string, seq int")
    assert rows(sinks.insert_ignore(old, new, ["url"], "seq")) == [("u1", "x"), ("u2", "a")]


def test_validated_predictions(spark):
    df = spark.createDataFrame([(7, [1.0], 0.3), (2, [1.0] * 5, 0.25)], "years int, magnitude_5 array<double>, prob_up double")
    assert rows(sinks.validated_predictions(df)) == rows(spark.createDataFrame([(1, None, 0.3, 0.7), (2, [1.0] * 5, 0.25, 0.75)], "a int, b array<double>, c double, d double"))


def test_default_row(spark):
    df = spark.createDataFrame([], "day string, n int")
    assert rows(scan.default_row(df, {"day": "today", "n": 0})) == [("today", 0)]
    assert rows(scan.default_row(spark.createDataFrame([("x", 1)], "day string, n int"), {"day": "today", "n": 0})) == [("x", 1)]


def test_paging_bounds(spark):
    df = spark.range(30)
    assert scan.page(df, [F.col("id")], 0, 0).count() == 1
    assert scan.page(df, [F.col("id")], 2, 20).count() == 10
    assert scan.page_count(df, 20) == 2


def test_divisions_by_zero_are_null(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0)], "symbol string, bar_date int, close double")
    assert [r[0] for r in df.select(series.change("close", series.window())).collect()] == [None, None]
    flat = spark.createDataFrame([("a", i, 2.0) for i in range(3)], "symbol string, bar_date int, close double")
    assert {r[0] for r in flat.select(series.normalise(flat, "close")).collect()} == {0.0}
    assert {r[0] for r in flat.select(series.normalise(flat, "close", "minmax")).collect()} == {0.5}
    with pytest.raises(ValueError):
        series.normalise(flat, "close", "other")


def test_market_features_fall_back(spark):
    empty = spark.createDataFrame([], "bar_date int, a int")
    other = spark.createDataFrame([(1, 2)], "bar_date int, b int")
    assert rows(market.market_features(empty, other, empty)) == [(1, 2)]


def test_text_rules(spark):
    df = spark.createDataFrame([("AI芯片",), ("",), (None,)], "t string")
    assert sorted(r[0] for r in df.select(text.first_category(F.col("t"))).collect()) == ["general", "general", "行业"]
    reply = spark.createDataFrame([('x {"action": "buy"} y',), ("none",), (None,)], "r string")
    assert sorted(r[0][0] for r in reply.select(text.parse_advice(F.col("r"))).collect()) == ["buy", "hold", "hold"]
    asked = text.ask_model(df.where("t <> ''"), F.col("t"), lambda prompts: [p + "!" for p in prompts])
    assert [r.reply for r in asked.collect()] == ["AI芯片!"]
    assert text.news_codes(spark).count() == 20


def test_rate_gate(spark):
    times = [(f"2024-01-01 {h:02d}:00:00",) for h in (0, 1, 6, 12, 18, 23)]
    df = spark.createDataFrame(times, "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert monitoring.gap_allowed(df).count() == 4


def test_deploy_gate(spark):
    df = spark.createDataFrame([(0.8, 0.7, 1.0, 1.0), (0.7, 0.7, 0.95, 1.0), (0.7, None, 1.0, None)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(monitoring.should_deploy(*map(F.col, "abcd"))).collect()] == [True, False, True]


def test_auc_by_pairs(spark):
    import random

    r = random.Random(1)
    data = [(r.random() < 0.4, round(r.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame([(float(y), s) for y, s in data], "label double, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert ml.auc(df, "s").first()[0] == pytest.approx(want)
    weights, best = ml.best_weights(df.withColumn("z", 1 - F.col("s")), ["s", "z"])
    assert best >= want - 0.01 and sum(weights) == pytest.approx(1)


def test_files(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("日期,收盘,成交量\n2024-01-31,1.5,10\nbad,2,3\n", encoding="utf-8-sig")
    assert rows(readers.read_bars_csv(spark, str(tmp_path / "bars.csv"))) == [(DAY, 1.5, 10.0)]
    (tmp_path / "nav.csv").write_text("净值日期,单位净值\n2024-01-31,1.25\n", encoding="utf-8")
    assert rows(readers.read_nav_csv(spark, str(tmp_path / "nav.csv"))) == [(DAY, 1.25, None)]
    with pytest.raises(ValueError):
        readers.read_benchmark_csv(spark, str(tmp_path / "nav.csv"))
    sinks.write_json_report(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_text_report(spark.range(1), str(tmp_path / "t"), "row %d")
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "row 0"


def test_messages(spark):
    df = spark.createDataFrame([('{"count": 3}',), ("plain",)], "payload string")
    out = readers.message_fields(df, "payload", "count int").collect()
    assert out[0].fields["count"] == 3 and out[0].raw is None and out[1].raw == "plain"


def test_rate_gate_counts_from_the_last_run_let_through(spark):
    times = ["00:00", "03:00", "06:00", "09:00", "23:30"]
    rows_ = [("a", f"2024-01-01 {t}:00") for t in times] + [("a", "2024-01-02 00:30:00"), ("a", None), ("b", "2024-01-01 09:00:00"), ("b", "2024-01-01 09:00:00"), (None, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows_, "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.k or "", r.ts.strftime("%d %H:%M")) for r in monitoring.gap_allowed(df, key="k").collect())
    assert got == [("", "01 10:00"), ("a", "01 00:00"), ("a", "01 06:00"), ("a", "01 23:30"), ("b", "01 09:00")]
    assert monitoring.gap_allowed(df.limit(0)).count() == 0


def test_upserts_take_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 1), (2, "c", 1)], "k int, v string, t int")
    assert rows(sinks.upsert(old, new, ["k"], seq="t")) == [(1, "b", 2), (2, "c", 1)]
    assert rows(sinks.upsert(old, new, ["k"])) == [(1, "z", 1), (2, "c", 1)]


def test_pivot_takes_the_last_value_by_its_order(spark):
    df = spark.createDataFrame([(DAY, "x", 5.0, 1), (DAY, "x", 2.0, 2), (DAY, "x", None, 3)], "bar_date date, symbol string, close double, seq int")
    assert market.pivot_last(df, ["x", "y"], "seq").first()[1:] == (2.0, None)


def test_ranks_and_groups_against_sorting(spark):
    values = [1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 5.0, 8.0, 9.0, 9.5, 10.0, 12.0]
    df = spark.createDataFrame([("s", DAY, f, v * (1 if f == "up" else -1), float(i)) for f in ("up", "down") for i, v in enumerate(values)], "symbol string, bar_date date, factor string, value double, forward double")
    ranks = statistics.with_average_rank(df, "value", ["factor"], "rank").where("factor = 'up'").orderBy("forward").collect()
    assert [r["rank"] for r in ranks] == [1.5, 1.5, 3, 5, 5, 5, 7, 8, 9, 10, 11, 12]
    got = {r.factor: r for r in statistics.group_returns(df, groups=2).collect()}
    assert (got["up"].group_1, got["up"].group_2) == (2.5, 8.5) and got["down"].group_1 == 8.5
    assert statistics.information_coefficients(df.limit(0)).count() == 0


def test_holdout_metrics_by_hand(spark):
    pairs = [(0.9, 1.0), (0.8, 0.0), (0.5, 1.0), (0.2, 1.0), (0.1, 0.0)]
    got = ml.holdout_metrics(spark.createDataFrame(pairs, "p double, label double")).first()
    assert (got.accuracy, got.precision, got.recall) == (0.6, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert got.f1 == pytest.approx(2 / 3) and got.mse == pytest.approx(sum((p - y) ** 2 for p, y in pairs) / 5)
    weights, best = ml.best_weights(spark.createDataFrame([(0.1 * i, 1 - 0.1 * i + 0.001 * (i % 2), float(i > 5)) for i in range(10)], "a double, b double, label double"), ["a", "b"])
    assert weights == [1.0, 0.0] and best == 1.0
