"""Risk and benchmark figures of each key, from one aggregation over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import correlation, divide
from .series import TRADING_DAYS, with_drawdown, with_returns

RISK_FREE = 0.03


def _year() -> Column:
    return F.sqrt(F.lit(float(TRADING_DAYS)))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def risk_metrics(df: DataFrame, price: str = "close", key: str = "symbol", date: str = "bar_date", risk_free: float = RISK_FREE, target: float = 0.0) -> DataFrame:
    """Annual return, volatility, Sharpe, drawdown, Calmar, Sortino, win rate and profit-loss ratio.

    A year is 252 rows and the span of n rows is n / 252 years; ratios with a zero divisor are 0.
    """
    rows = with_drawdown(with_returns(df, price, key, date), price, key, date)
    r = F.col("ret")
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min_by(price, date).alias("_first"),
        F.max_by(price, date).alias("_last"),
        F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < target, r)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(r > 0, r)).alias("_gain"),
        F.avg(F.when(r < 0, r)).alias("_loss"),
    )
    annual = F.when(F.col("n") < 2, 0.0).otherwise(F.pow(divide(F.col("_last"), F.col("_first")), TRADING_DAYS / F.col("n")) - 1)
    out = sums.withColumns({"annual_return": annual, "volatility": F.col("_sd") * _year()})
    over = F.col("annual_return") - risk_free
    return out.select(
        key,
        "n",
        "annual_return",
        "volatility",
        _or_zero(divide(over, F.col("volatility"))).alias("sharpe"),
        "max_drawdown",
        _or_zero(divide(F.col("annual_return"), F.abs("max_drawdown"))).alias("calmar"),
        _or_zero(divide(over, F.col("_down") * _year())).alias("sortino"),
        "win_rate",
        _or_zero(divide(F.col("_gain"), F.abs("_loss"))).alias("profit_loss_ratio"),
    )


def value_at_risk(df: DataFrame, returns: str = "ret", alpha: float = 0.05, key: str = "symbol") -> DataFrame:
    """Historical VaR (interpolated percentile) and CVaR (mean of the returns at or below it)."""
    rows = df.where(F.col(returns).isNotNull())
    cut = rows.groupBy(key).agg(F.percentile(returns, F.lit(alpha)).alias("var"))
    below = rows.join(cut, key).groupBy(key).agg(F.first("var").alias("var"), F.avg(F.when(F.col(returns) <= F.col("var"), F.col(returns))).alias("cvar"))
    return below


def benchmark_metrics(df: DataFrame, benchmark: DataFrame, returns: str = "ret", bench: str = "bench_ret", key: str = "symbol", date: str = "bar_date", risk_free: float = RISK_FREE, least: int = 10) -> DataFrame:
    """Alpha, beta, R squared, information ratio and tracking error over the dates that both have.

    benchmark: (date, bench).  Below `least` common rows, or without variance, alpha is 0 and beta 1.
    """
    daily = risk_free / TRADING_DAYS
    both = df.join(benchmark, date).where(F.col(returns).isNotNull() & F.col(bench).isNotNull())
    x, y = F.col(bench) - daily, F.col(returns) - daily
    gap = F.col(returns) - F.col(bench)
    sums = both.groupBy(key).agg(
        F.count("*").alias("n"),
        F.covar_samp(x, y).alias("_cov"),
        F.var_samp(x).alias("_var"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        correlation(returns, bench).alias("_corr"),
        F.avg(gap).alias("_gap"),
        F.stddev_samp(gap).alias("_gap_sd"),
        F.stddev_samp(bench).alias("_bench_sd"),
    )
    known = (F.col("n") >= least) & (F.col("_var") > 0)
    beta = F.when(known, F.col("_cov") / F.nullif(F.col("_var"), F.lit(0.0))).otherwise(1.0)
    out = sums.withColumn("beta", beta)
    return out.select(
        key,
        "n",
        F.when(known, (F.col("_my") - F.col("beta") * F.col("_mx")) * TRADING_DAYS).otherwise(0.0).alias("alpha"),
        "beta",
        F.when(F.col("n") >= least, F.coalesce(F.pow("_corr", F.lit(2)), F.lit(0.0))).otherwise(0.0).alias("r_squared"),
        _or_zero(divide(F.col("_gap") * TRADING_DAYS, F.col("_gap_sd") * _year())).alias("information_ratio"),
        (F.col("_gap_sd") * _year()).alias("tracking_error"),
        (F.col("_bench_sd") * _year()).alias("benchmark_volatility"),
        (F.col("_bench_sd") * TRADING_DAYS).alias("benchmark_volatility_compat"),
    )


def regression_errors(df: DataFrame, actual: str, fitted: str, key: str = "symbol") -> DataFrame:
    """RMSE, MAE, MAPE (where the actual isn't 0) and R squared."""
    e = F.col(actual) - F.col(fitted)
    rows = df.where(e.isNotNull())
    sums = rows.groupBy(key).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.col(actual) != 0, F.abs(e / F.nullif(F.col(actual), F.lit(0.0)))) * 100).alias("mape"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(actual) * F.count("*")).alias("_sst"),
    )
    return sums.select(key, "rmse", "mae", "mape", (1 - divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def risk_level(drawdown: Column, volatility: Column) -> Column:
    """high, medium or low by drawdown, then by volatility."""
    depth = F.abs(drawdown)
    return F.when(depth > 0.25, "high").when(depth <= 0.15, "low").when(volatility > 0.4, "high").when(volatility < 0.2, "low").otherwise("medium")


def predictability(r2: Column, entropy: Column) -> Column:
    """medium without r2; an entropy that is missing speaks neither for nor against."""
    rated = F.when((r2 > 0.85) & (entropy.isNull() | (entropy < 1.2)), "high").when((r2 < 0.5) | (entropy > 1.5), "low").otherwise("medium")
    return F.when(r2.isNull(), "medium").otherwise(rated)


# The bounds and words of a report's conclusions: metric, decimals, and by condition what is told and its summary.
CONCLUSIONS = (
    ("趋势", "hurst", 4, ((lambda x: x > 0.6, "趋势增强", "序列呈现趋势增强特征，价格走势具有持续性"), (lambda x: x < 0.4, "均值回复", "序列呈现均值回复特征，价格倾向于向均值回归"), (None, "随机游走", "序列接近随机游走，短期预测难度较大"))),
    ("复杂度", "sample_entropy", 4, ((lambda x: x < 1.0, "低复杂度", "序列复杂度较低，存在一定规律性和可预测性"), (lambda x: x > 1.5, "高复杂度", "序列复杂度较高，随机性强，预测难度大"), (None, "中等复杂度", "序列复杂度中等"))),
    ("周期", "period", 1, ((None, "存在显著周期", "主周期约 %.1f 天，可作为交易周期参考"),)),
    ("可预测性", "r2", 4, ((lambda x: x > 0.9, "高", "ARIMA 拟合优度高，短期预测相对可靠"), (lambda x: x > 0.6, "中", "ARIMA 拟合一般，预测需谨慎参考"), (None, "低", "ARIMA 拟合较差，预测参考价值有限"))),
    ("风险", "drawdown_pct", 2, ((lambda x: x > 25, "高", "最大回撤 %.1f%%，风险较高"), (lambda x: x > 15, "中", "最大回撤 %.1f%%，风险中等"), (None, "低", "最大回撤 %.1f%%，相对可控"))),
    ("技术信号", "rsi", 2, ((lambda x: x >= 70, "超买", "RSI 超买区域，短期可能回调"), (lambda x: x <= 30, "超卖", "RSI 超卖区域，短期可能反弹"))),
)
SIGNAL, NEUTRAL = ("技术信号", "综合信号: %s"), "中性"
SUGGESTIONS = {
    "trend": "趋势特征明显且模型拟合良好，建议采用趋势跟踪策略，可参考 ARIMA 预测方向辅助决策。",
    "reversion": "均值回复特征明显，建议关注网格交易或均值回归策略，关注价格偏离均线的程度。",
    "random": "序列接近随机，建议短线谨慎、中长期观察，结合基本面与技术面综合判断。",
    "complex": "高复杂度表明市场效率较高，量化模型预测优势有限，建议控制仓位与止损。",
    "oscillator": "当前 RSI 处于极值区，可结合超买超卖信号把握短期波动。",
}
NOTHING, ADVICE = "数据不足或分析未产出有效结论。", " 策略建议: "


def _conclusion(category: str, value: Column, summary: Column, word: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), summary.alias("summary"), value.cast("double").alias("value"), word.alias("interpretation"))


def conclusions(df: DataFrame) -> DataFrame:
    """df with `conclusions`: (category, summary, value, interpretation) of each metric that is there and tells.

    Metrics are hurst, sample_entropy, period, r2, max_drawdown (a fraction), rsi, and `signal`, the
    combined technical signal, where df has it.
    """
    metrics = {name: F.col(name).cast("double") for _, name, _, _ in CONCLUSIONS if name != "drawdown_pct"} | {"drawdown_pct": F.abs(F.col("max_drawdown").cast("double")) * 100}
    told = []
    for category, name, digits, rules in CONCLUSIONS:
        x = metrics[name]
        for i, (fits, word, summary) in enumerate(rules):
            before = [f(x) for f, _, _ in rules[:i]]
            here = x.isNotNull() & (fits(x) if fits else F.lit(True))
            for b in before:
                here = here & ~b
            text = F.format_string(summary, x) if "%" in summary else F.lit(summary)
            told.append(F.when(here, _conclusion(category, F.round(x, digits), text, F.lit(word))))
    if "signal" in df.columns:
        signal = F.col("signal")
        told.append(F.when(signal.isNotNull() & ~signal.isin("", NEUTRAL), _conclusion(SIGNAL[0], F.lit(None), F.format_string(SIGNAL[1], signal), signal)))
    return df.withColumn("conclusions", F.array_compact(F.array(*told)))


def suggestions(hurst: Column, entropy: Column, r2: Column, rsi: Column) -> Column:
    """An array of SUGGESTIONS: a course where hurst and r2 are known, then complexity and the oscillator."""
    words = {k: F.lit(v) for k, v in SUGGESTIONS.items()}
    course = F.when((hurst > 0.55) & (r2 > 0.85), words["trend"]).when(hurst < 0.45, words["reversion"]).otherwise(words["random"])
    return F.array_compact(F.array(F.when(hurst.isNotNull() & r2.isNotNull(), course), F.when(entropy > 1.5, words["complex"]), F.when((rsi >= 70) | (rsi <= 30), words["oscillator"])))


def one_paragraph(told: Column, advice: Column) -> Column:
    """The first five summaries and the first two suggestions."""
    summaries = F.transform(F.slice(told, 1, 5), lambda c: c["summary"])
    first = F.when(F.size(told) > 0, F.array_join(summaries, " ")).otherwise(F.lit(NOTHING))
    return F.when(F.size(advice) > 0, F.concat(first, F.lit(ADVICE), F.array_join(F.slice(advice, 1, 2), " "))).otherwise(first)
