"""Queries of readers, casts, diagnostics, gates and of the classifying stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import kernels, monitoring, risk, statistics, text
from ..operators.recurrence import fund_features, fund_sequences
from ..scratch import scratch_folder
from ..sources import readers, sinks
from ..streaming import events
from .inputs import AS_OF, BARS, RETURNS, bars, rounded, table
from .registry import query

S, D = SparkSession, DataFrame


# Readers: what the writers of a table leave is read back.


@query(f"WITH {BARS} SELECT symbol, bar_date, open, high, low, close, volume FROM bars")
def csv_bars(spark: S, sf: str) -> D:
    """Bars in a file with the source's column names, and a line that holds no date."""
    names = {"bar_date": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘", "volume": "成交量"}
    rows = bars(spark, sf).select("symbol", *names)
    bad = rows.limit(1).withColumns({"bar_date": F.lit(None).cast("date"), "close": F.lit(None).cast("double")})
    path = scratch_folder(spark, "bars-csv")
    sinks.write_csv_report(rows.unionByName(bad).withColumnsRenamed(names), path)
    return readers.read_bars_csv(spark, path).select("symbol", *names)


@query(f"WITH {BARS} SELECT bar_date AS nav_date, close AS unit_nav, high AS accum_nav FROM bars WHERE symbol = '1-URGENT'")
def csv_fund_nav(spark: S, sf: str) -> D:
    path = scratch_folder(spark, "nav-csv")
    rows = bars(spark, sf).where("symbol = '1-URGENT'").select(F.date_format("bar_date", "yyyyMMdd").alias("净值日期"), F.col("close").alias("单位净值"), F.col("high").alias("累计净值"))
    sinks.write_csv_report(rows, path)
    return readers.read_nav_csv(spark, path)


@query(f"WITH {BARS} SELECT bar_date, close AS close_price FROM bars WHERE symbol = '2-HIGH'")
def csv_benchmark(spark: S, sf: str) -> D:
    path = scratch_folder(spark, "benchmark-csv")
    sinks.write_csv_report(bars(spark, sf).where("symbol = '2-HIGH'").select(F.col("bar_date").alias("date"), F.col("close").alias("Close")), path)
    return readers.read_benchmark_csv(spark, path)


@query("SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k, NULL::VARCHAR AS raw FROM events")
def message_log(spark: S, sf: str) -> D:
    """Events as JSON messages, parsed again."""
    sent = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    sent = sent.select("event_id", readers.encode_message("kind", "k").alias("payload"))
    return readers.message_fields(sent, "payload", "kind string, k int").select("event_id", "fields.kind", "fields.k", "raw")


# Casts.


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def safe_casts(spark: S, sf: str) -> D:
    """Numbers and dates of mixed spellings: text that is none, and NaN, are null."""
    k = F.col("o_orderkey")
    price = F.when(k % 3 == 0, F.col("o_totalprice").cast("string")).when(k % 3 == 1, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).otherwise(F.when(k % 2 == 0, "n/a").otherwise("NaN"))
    day = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    rows = table(spark, sf, "orders").select("o_orderkey", price.alias("p"), day.alias("d"))
    return rows.select("o_orderkey", scalar.safe_double(F.col("p")).alias("price"), scalar.safe_date(F.col("d")).alias("day"))


@query(f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS s, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 - 30 AS INTEGER) END AS e FROM orders),
l AS (SELECT *, least(coalesce(e, DATE '{AS_OF}'), DATE '{AS_OF}') AS last FROM d)
SELECT o_orderkey, least(coalesce(s, last - 365), last) AS first_day, last AS last_day FROM l""")
def clamped_ranges(spark: S, sf: str) -> D:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 > 0, day).alias("s"), F.when(k % 5 > 0, F.date_add(day, (k % 90 - 30).cast("int"))).alias("e"))
    first, last = scalar.clamp_dates(F.col("s"), F.col("e"), F.lit(AS_OF).cast("date"))
    return rows.select("o_orderkey", first.alias("first_day"), last.alias("last_day"))


# Diagnostics.

_DIAGNOSIS = f"{RETURNS}, q AS (SELECT symbol, bar_date, ret, close, open, volume, 1.0::DOUBLE AS one FROM r WHERE ret IS NOT NULL)"


@query(f"""WITH {_DIAGNOSIS} SELECT 'volume' AS feature, round(corr(volume, ret), 6) + 0.0 AS corr FROM q UNION ALL SELECT 'open', round(corr(open, ret), 6) + 0.0 FROM q UNION ALL SELECT 'one', 0.0""")
def feature_target_correlation(spark: S, sf: str) -> D:
    rows = bars(spark, sf).withColumn("ret", _change()).where("ret IS NOT NULL").withColumn("one", F.lit(1.0))
    return rounded(statistics.correlation_or_zero(rows, ["volume", "open", "one"], "ret"))


def _change():
    from ..operators.series import change, window

    return change("close", window())


@query(f"""WITH {BARS}, s AS (SELECT stddev_pop(open) / stddev_pop(close) AS q FROM bars)
SELECT round(q, 6) AS std_ratio, q < 0.3 AS is_flat, FALSE AS weak_features, TRUE AS small_model, round(1 - least(1.0, abs(1 - q)), 6) AS volatility_match FROM s""")
def flat_prediction(spark: S, sf: str) -> D:
    return rounded(statistics.flatness(bars(spark, sf), "open", "close", 0.4, 5000))


@query(f"WITH {BARS} SELECT symbol, max(bar_date) AS last_trained, CAST(DATE '2001-08-02' - max(bar_date) AS INTEGER) AS age_days, CASE WHEN DATE '2001-08-02' - max(bar_date) >= 30 THEN 'stale' ELSE 'fresh' END AS status FROM bars GROUP BY symbol")
def model_health(spark: S, sf: str) -> D:
    """Each bar counts as a training run of its symbol."""
    return monitoring.model_health(bars(spark, sf).select("symbol", F.col("bar_date").alias("trained_at")), "2001-08-02")


@query(f"""WITH {BARS}, p AS (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS peak, close / open - 1 AS move FROM bars),
m AS (SELECT symbol, min(close / peak - 1) AS dd, stddev_samp(move) AS vol FROM p GROUP BY symbol)
SELECT symbol, CASE WHEN abs(dd) > 0.25 THEN 'high' WHEN abs(dd) <= 0.15 THEN 'low' WHEN vol > 0.4 THEN 'high' WHEN vol < 0.2 THEN 'low' ELSE 'medium' END AS risk, CASE WHEN vol > 0.85 AND abs(dd) < 1.2 THEN 'high' WHEN vol < 0.5 OR abs(dd) > 1.5 THEN 'low' ELSE 'medium' END AS predictability FROM m""")
def risk_rules(spark: S, sf: str) -> D:
    from pyspark.sql import Window

    peak = F.max("close").over(Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0))
    m = bars(spark, sf).withColumn("peak", peak).groupBy("symbol").agg(F.min(F.col("close") / F.col("peak") - 1).alias("dd"), F.stddev_samp(F.col("close") / F.col("open") - 1).alias("vol"))
    return m.select("symbol", risk.risk_level(F.col("dd"), F.col("vol")).alias("risk"), risk.predictability(F.col("vol"), F.abs("dd")).alias("predictability"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
g AS (SELECT user_id, i, event_id, ts, TRUE AS let, ts AS last, CAST(ts AS DATE) AS day, 1 AS n FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.ts, ok, CASE WHEN ok THEN e.ts ELSE g.last END, CASE WHEN ok THEN CAST(e.ts AS DATE) ELSE g.day END, CASE WHEN ok THEN today + 1 ELSE g.n END
  FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1, LATERAL (SELECT CASE WHEN g.day = CAST(e.ts AS DATE) THEN g.n ELSE 0 END AS today), LATERAL (SELECT e.ts - g.last >= INTERVAL 4 HOUR AND today < 4 AS ok))
SELECT user_id, event_id, ts FROM g WHERE let""")
def rate_gate(spark: S, sf: str) -> D:
    """Events of each user at least 4 hours after the last one let through, 4 a day at most."""
    return monitoring.gap_allowed(table(spark, sf, "events").select("user_id", "event_id", "ts"), key="user_id")


_METRICS = """m AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_size / 50 END AS h, CASE WHEN p_size % 5 > 0 THEN p_retailprice % 2 END AS e, CASE WHEN p_size % 7 = 0 THEN p_size END AS p, CASE WHEN p_partkey % 13 > 0 THEN p_retailprice % 1 END AS r,
  CASE WHEN p_partkey % 17 > 0 THEN p_size % 40 END AS d, CASE WHEN p_partkey % 19 > 0 THEN p_size * 2 END AS o, CASE p_partkey % 4 WHEN 0 THEN '超买' WHEN 1 THEN '超卖' WHEN 2 THEN '中性' END AS g FROM part)"""


def _metrics(spark: S, sf: str) -> D:
    """Metrics that the parts stand in for, some of them missing."""
    size, price, k = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    metrics = {"hurst": F.when(k % 11 > 0, size / 50), "sample_entropy": F.when(size % 5 > 0, price % 2), "period": F.when(size % 7 == 0, size), "r2": F.when(k % 13 > 0, price % 1), "max_drawdown": F.when(k % 17 > 0, -(size % 40) / 100), "rsi": F.when(k % 19 > 0, size * 2.0), "signal": F.when(k % 4 == 0, "超买").when(k % 4 == 1, "超卖").when(k % 4 == 2, "中性")}
    return table(spark, sf, "part").select("p_partkey", *[c.alias(name) for name, c in metrics.items()])


@query(f"""WITH {_METRICS}, t AS (SELECT *, list_filter([CASE WHEN h > 0.6 THEN '趋势=趋势增强=序列呈现趋势增强特征，价格走势具有持续性' WHEN h < 0.4 THEN '趋势=均值回复=序列呈现均值回复特征，价格倾向于向均值回归' WHEN h IS NOT NULL THEN '趋势=随机游走=序列接近随机游走，短期预测难度较大' END,
  CASE WHEN e < 1 THEN '复杂度=低复杂度=序列复杂度较低，存在一定规律性和可预测性' WHEN e > 1.5 THEN '复杂度=高复杂度=序列复杂度较高，随机性强，预测难度大' WHEN e IS NOT NULL THEN '复杂度=中等复杂度=序列复杂度中等' END,
  '周期=存在显著周期=主周期约 ' || p || '.0 天，可作为交易周期参考',
  CASE WHEN r > 0.9 THEN '可预测性=高=ARIMA 拟合优度高，短期预测相对可靠' WHEN r > 0.6 THEN '可预测性=中=ARIMA 拟合一般，预测需谨慎参考' WHEN r IS NOT NULL THEN '可预测性=低=ARIMA 拟合较差，预测参考价值有限' END,
  CASE WHEN d > 25 THEN '风险=高=最大回撤 ' || d || '.0%，风险较高' WHEN d > 15 THEN '风险=中=最大回撤 ' || d || '.0%，风险中等' ELSE '风险=低=最大回撤 ' || d || '.0%，相对可控' END,
  CASE WHEN o >= 70 THEN '技术信号=超买=RSI 超买区域，短期可能回调' WHEN o <= 30 THEN '技术信号=超卖=RSI 超卖区域，短期可能反弹' END, CASE WHEN g <> '中性' THEN '技术信号=' || g || '=综合信号: ' || g END], lambda x: x IS NOT NULL) AS told,
  list_filter([CASE WHEN h IS NULL OR r IS NULL THEN NULL WHEN h > 0.55 AND r > 0.85 THEN '趋势特征明显且模型拟合良好，建议采用趋势跟踪策略，可参考 ARIMA 预测方向辅助决策。' WHEN h < 0.45 THEN '均值回复特征明显，建议关注网格交易或均值回归策略，关注价格偏离均线的程度。' ELSE '序列接近随机，建议短线谨慎、中长期观察，结合基本面与技术面综合判断。' END,
  CASE WHEN e > 1.5 THEN '高复杂度表明市场效率较高，量化模型预测优势有限，建议控制仓位与止损。' END, CASE WHEN o >= 70 OR o <= 30 THEN '当前 RSI 处于极值区，可结合超买超卖信号把握短期波动。' END], lambda x: x IS NOT NULL) AS advice FROM m),
s AS (SELECT *, list_transform(told, lambda x: string_split(x, '=')[3]) AS summaries FROM t)
SELECT p_partkey, array_to_string(told, ';') AS told, array_to_string(advice, ';') AS advice, CASE WHEN len(told) > 0 THEN array_to_string(summaries[1:5], ' ') ELSE '数据不足或分析未产出有效结论。' END || CASE WHEN len(advice) > 0 THEN ' 策略建议: ' || array_to_string(advice[1:2], ' ') ELSE '' END AS paragraph FROM s""")
def report_conclusions(spark: S, sf: str) -> D:
    """The rule table over metrics, some of them missing, with summaries, suggestions and the paragraph made of them."""
    rows = risk.conclusions(_metrics(spark, sf)).withColumn("advice", risk.suggestions(F.col("hurst"), F.col("sample_entropy"), F.col("r2"), F.col("rsi")))
    told = F.transform("conclusions", lambda c: F.concat_ws("=", c["category"], c["interpretation"], c["summary"]))
    return rows.select("p_partkey", F.array_join(told, ";").alias("told"), F.array_join("advice", ";").alias("advice"), risk.one_paragraph(F.col("conclusions"), F.col("advice")).alias("paragraph"))


@query(f"""WITH {_METRICS} SELECT p_partkey, CASE WHEN r IS NULL THEN 'medium' WHEN r > 0.85 AND (e IS NULL OR e < 1.2) THEN 'high' WHEN r < 0.5 OR e IS NOT NULL AND e > 1.5 THEN 'low' ELSE 'medium' END AS predictability FROM m""")
def predictability_rules(spark: S, sf: str) -> D:
    """With and without an entropy and a fit."""
    return _metrics(spark, sf).select("p_partkey", risk.predictability(F.col("r2"), F.col("sample_entropy")).alias("predictability"))


_FUND = """WITH RECURSIVE {bars}, k AS (SELECT symbol, bar_date, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS i FROM bars),
e AS (SELECT symbol, bar_date, i, close AS f, close AS s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, close, 0.0::DOUBLE AS sig FROM k WHERE i = 1
  UNION ALL SELECT k.symbol, k.bar_date, k.i, e.f + (k.close - e.f) * 2 / 13, e.s + (k.close - e.s) * 2 / 27, e.g + (greatest(k.close - e.close, 0) - e.g) / 14, e.l + (greatest(e.close - k.close, 0) - e.l) / 14, k.close,
    e.sig + ((e.f + (k.close - e.f) * 2 / 13) - (e.s + (k.close - e.s) * 2 / 27) - e.sig) * 2 / 10 FROM e JOIN k ON k.symbol = e.symbol AND k.i = e.i + 1),
c AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM e WINDOW w AS (PARTITION BY symbol ORDER BY i)),
v AS (SELECT *, avg(close) OVER t AS mid, stddev_samp(close) OVER t AS sd, avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) AS m5, stddev_samp(ret) OVER t AS vol, count(ret) OVER t AS n FROM c WINDOW t AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))"""


@query(_FUND.format(bars=BARS) + """
SELECT symbol, bar_date AS nav_date, round(ret, 4) + 0.0 AS return, CASE WHEN l > 0 THEN round(100 - 100 / (1 + g / l), 4) + 0.0 END AS rsi, round(f - s, 3) + 0.0 AS macd, round(sig, 3) + 0.0 AS macd_signal, round(f - s - sig, 3) + 0.0 AS macd_hist,
  CASE WHEN i >= 20 THEN round((close - mid + 2 * sd) / (4 * sd + 1e-8), 4) + 0.0 END AS bb_position, CASE WHEN n = 20 THEN round(vol * 100, 4) + 0.0 END AS volatility, CASE WHEN i >= 20 THEN round(m5 / (mid + 1e-8), 4) + 0.0 END AS ma_ratio_5_20 FROM v""")
def fund_feature_block(spark: S, sf: str) -> D:
    out = fund_features(_navs(spark, sf))
    waves = {c: F.round(c, 3) for c in ("macd", "macd_signal", "macd_hist")}
    return rounded(out.withColumns(waves), 4)


def _navs(spark: S, sf: str) -> D:
    return bars(spark, sf).select("symbol", F.col("bar_date").alias("nav_date"), F.col("close").alias("unit_nav"))


@query(f"""WITH {RETURNS}, k AS (SELECT symbol, bar_date, ret, row_number() OVER w AS i, list(coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))
SELECT symbol, bar_date AS nav_date, round(ret, 4) + 0.0 AS next_return, CAST(ret > 0 AS INTEGER) AS direction, round(list_sum(f), 3) + 0.0 AS five_days FROM k WHERE i > 5""")
def fund_sequences_of_5(spark: S, sf: str) -> D:
    """The five days of features before each day, told by the sum of their returns."""
    rows = fund_sequences(fund_features(_navs(spark, sf)))
    five = F.aggregate("features", F.lit(0.0), lambda s, x: s + F.coalesce(x[0], F.lit(0.0)))
    return rows.select("symbol", "nav_date", (F.round("next_return", 4) + 0.0).alias("next_return"), "direction", (F.round(five, 3) + 0.0).alias("five_days"))


@query()
def dtw_path_to_reference(spark: S, sf: str) -> D:
    """The path by which each symbol's whole series is warped onto that of 1-URGENT: a row a step, so as many as bars."""
    curves = bars(spark, sf).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("bar_date", "close"))), lambda r: r["close"]).alias("curve"))
    reference = curves.where("symbol = '1-URGENT'").select(F.col("curve").alias("reference"))
    pairs = curves.join(F.broadcast(reference)).repartition("symbol")  # one series

    @F.pandas_udf("array<struct<step:int,left_place:int,right_place:int>>")
    def path(x: pd.Series, y: pd.Series) -> pd.Series:
        found = [kernels.dtw_path(kernels.normalised(np.asarray(a)), kernels.normalised(np.asarray(b)))[1] for a, b in zip(x, y, strict=True)]
        return pd.Series([[{"step": k, "left_place": i, "right_place": j} for k, (i, j) in enumerate(p)] for p in found])

    return pairs.select("symbol", F.inline(path("reference", "curve")))


# The stream that classifies crawled news and puts it in by key.


@query("""SELECT event_id AS news_id, CASE event_type WHEN 'click' THEN '宏观' WHEN 'view' THEN '政策' WHEN 'purchase' THEN '公司' ELSE 'general' END AS category FROM events""")
def stream_classified(spark: S, sf: str) -> D:
    base = scratch_folder(spark, "classified")

    def classify(batch: D) -> D:
        kind = F.col("event_type")
        title = F.when(kind == "click", "央行降息").when(kind == "view", "证监会新政策").when(kind == "purchase", "公司业绩下滑").otherwise("nothing")
        return batch.select(F.col("event_id").alias("news_id"), text.first_category(title).alias("category"))

    stream = events.read_events(spark, sf, "events.parquet")
    events.classify_and_upsert(stream, f"{base}/checkpoint", f"{base}/out", classify, ["news_id"]).awaitTermination()
    return events.latest(spark, f"{base}/out", "news_id long, category string", ["news_id"])
