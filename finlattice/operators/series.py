"""Ordered-series columns over windows of one key.

Every function takes column names and returns a Column; all share window(key, date), so Spark
plans one sort and one Window for any number of them.  A full window is required unless stated:
values before it are null, as are divisions by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import correlation, divide

KEY, DATE = "symbol", "bar_date"
TRADING_DAYS = 252


def window(key: str = KEY, date: str = DATE) -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def full(value: Column, of: str | Column, w: WindowSpec, n: int) -> Column:
    """value where the last n rows all have `of`."""
    return F.when(F.count(_col(of)).over(last(w, n)) == n, value)


def change(c: str, w: WindowSpec, n: int = 1) -> Column:
    return divide(F.col(c), F.lag(c, n).over(w)) - 1


def log_change(c: str, w: WindowSpec) -> Column:
    return F.ln(divide(F.col(c), F.lag(c).over(w)))


def mean(c: str | Column, w: WindowSpec, n: int, partial: bool = False) -> Column:
    value = F.avg(_col(c)).over(last(w, n))
    return value if partial else full(value, c, w, n)


def deviation(c: str | Column, w: WindowSpec, n: int) -> Column:
    return full(F.stddev_samp(_col(c)).over(last(w, n)), c, w, n)


def highest(c: str, w: WindowSpec, n: int) -> Column:
    return full(F.max(c).over(last(w, n)), c, w, n)


def lowest(c: str, w: WindowSpec, n: int) -> Column:
    return full(F.min(c).over(last(w, n)), c, w, n)


def bollinger(c: str, w: WindowSpec, n: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle and lower band."""
    m, s = mean(c, w, n), deviation(c, w, n)
    return m + width * s, m, m - width * s


def volatility(returns: str, w: WindowSpec, n: int = 20, annual: bool = True) -> Column:
    s = deviation(returns, w, n)
    return s * F.sqrt(F.lit(float(TRADING_DAYS))) if annual else s


def on_balance_volume(close: str, volume: str, w: WindowSpec) -> Column:
    """Running sum of volume signed by the close's move; the caller nests it in a select of its own."""
    return F.coalesce(F.signum(F.col(close) - F.lag(close).over(w)), F.lit(0.0)) * F.col(volume)


def running_sum(c: str, w: WindowSpec) -> Column:
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def typical(high: str = "high", low: str = "low", close: str = "close") -> Column:
    return (F.col(high) + F.col(low) + F.col(close)) / 3


def true_range(w: WindowSpec, high: str = "high", low: str = "low", close: str = "close") -> Column:
    before = F.lag(close).over(w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def aroon(c: str, w: WindowSpec, n: int, top: bool) -> Column:
    """100 * (rows since the window began) / n at its first highest (lowest) value."""
    values = F.collect_list(c).over(last(w, n))
    best = (F.max if top else F.min)(c).over(last(w, n))
    return full((F.array_position(values, best).cast("double")) / n * 100, c, w, n)


def fill(c: str, w: WindowSpec, forward: bool = True, backward: bool = False, zero: bool = True) -> Column:
    """Gaps take the value before them; backward (which looks ahead) only on request; then 0."""
    value = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if forward else F.col(c)
    if backward:
        value = F.coalesce(value, F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return F.coalesce(value, F.lit(0.0)) if zero else value


def min_max(c: str, w: WindowSpec, n: int = 60) -> Column:
    low, high = F.min(c).over(last(w, n)), F.max(c).over(last(w, n))
    return (F.col(c) - low) / (high - low + 1e-8)


def price_volume_divergence(close_change: str, volume_change: str, w: WindowSpec, n: int = 10) -> Column:
    both = F.coalesce(correlation(close_change, volume_change, last(w, n)), F.lit(0.0))
    return F.greatest(F.least(-both, F.lit(1.0)), F.lit(-1.0))


def rebased(c: str, w: WindowSpec) -> Column:
    """Percent above the key's first value."""
    return (divide(F.col(c), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1) * 100


def with_returns(df: DataFrame, price: str = "close", key: str = KEY, date: str = DATE, name: str = "ret") -> DataFrame:
    return df.withColumn(name, change(price, window(key, date)))


def with_drawdown(df: DataFrame, price: str = "close", key: str = KEY, date: str = DATE) -> DataFrame:
    """Adds peak (the highest so far) and drawdown (at most 0)."""
    peak = F.max(price).over(window(key, date).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("peak", peak).withColumn("drawdown", divide(F.col(price) - F.col("peak"), F.col("peak")))


def drawdown_dates(df: DataFrame, price: str = "close", key: str = KEY, date: str = DATE) -> DataFrame:
    """(key, max_drawdown, peak_date, trough_date): the deepest fall, its first trough, and the first highest day up to it."""
    w = window(key, date).rowsBetween(Window.unboundedPreceding, 0)
    rows = with_drawdown(df, price, key, date)
    rows = rows.withColumn("_peak_date", F.max(F.struct(F.col(price).alias("p"), (-F.unix_date(date)).alias("d"))).over(w))
    low = rows.groupBy(key).agg(F.min(F.struct(F.col("drawdown").alias("v"), F.col(date).alias("t"), F.col("_peak_date").alias("k"))).alias("m"))
    return low.select(key, F.col("m.v").alias("max_drawdown"), F.date_from_unix_date(-F.col("m.k.d")).alias("peak_date"), F.col("m.t").alias("trough_date"))


def money_flow_index(df: DataFrame, n: int = 14, key: str = KEY, date: str = DATE) -> DataFrame:
    """Adds mfi; days without a move count on neither side; null where nothing fell."""
    w = window(key, date)
    rows = df.withColumn("_tp", typical()).withColumn("_move", F.col("_tp") - F.lag("_tp").over(w))
    flow = F.col("_tp") * F.col("volume")
    rows = rows.withColumns({"_up": F.when(F.col("_move") > 0, flow).otherwise(0.0), "_down": F.when(F.col("_move") < 0, flow).otherwise(0.0)})
    ratio = divide(F.sum("_up").over(last(w, n)), F.sum("_down").over(last(w, n)))
    return rows.withColumn("mfi", full(100 - 100 / (1 + ratio), "_up", w, n)).drop("_tp", "_move", "_up", "_down")


def money_flow(df: DataFrame, key: str = KEY, date: str = DATE) -> DataFrame:
    """Adds flow (typical price times volume, signed by the close's move), its running sum, and the tier of amount.

    Tiers come from the key's 30th and 70th percentile over the whole series; null amounts count as 0.
    """
    w = window(key, date)
    rows = df.withColumn("_tp", typical()).withColumn("flow", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("_tp") * F.col("volume"))
    rows = rows.withColumn("flow_total", running_sum("flow", w)).withColumn("_amount", F.coalesce("amount", F.lit(0.0)))
    cuts = rows.groupBy(key).agg(F.percentile("_amount", F.array(F.lit(0.3), F.lit(0.7))).alias("_cut"), F.count("amount").alias("_n"))
    tier = F.when(F.col("_n") < 3, None).when(F.col("_amount") <= F.col("_cut")[0], "small").when(F.col("_amount") <= F.col("_cut")[1], "medium").otherwise("large")
    return rows.join(cuts, key).withColumn("tier", tier).drop("_tp", "_amount", "_cut", "_n")


def resample(df: DataFrame, rule: str = "week", key: str = KEY, date: str = DATE) -> DataFrame:
    """Weekly (Tuesday to Monday, labelled by the Monday) or monthly (labelled by the last day) bars."""
    label = F.next_day(F.date_sub(date, 1), "Mon") if rule == "week" else F.last_day(date)
    bars = df.groupBy(key, label.alias("bar_date")).agg(F.min_by("open", date).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", date).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
    return bars.where("close IS NOT NULL")


def volatility_block(df: DataFrame, key: str = KEY, date: str = DATE) -> DataFrame:
    """Twelve volatility features of each day; the flags compare with the key's deviation over its whole series."""
    w = window(key, date)
    zero = F.lit(0.0)
    before = F.lag("close").over(w)
    rows = df.withColumns({"ret": F.coalesce(change("close", w), zero), "volume_change": F.coalesce(change("volume", w), zero)})
    rows = rows.withColumns(
        {
            "abs_ret": F.abs("ret"),
            "sign_ret": F.signum("ret"),
            "range_ratio": (F.col("high") - F.col("low")) / (F.col("close") + 1e-8),
            "gap": F.coalesce((F.col("open") - before) / (F.coalesce(F.nullif(before, zero), F.first("close").over(w)) + 1e-8), zero),
            "hv5": F.coalesce(F.stddev_samp("ret").over(last(w, 5)), zero),
            "hv20": F.coalesce(F.stddev_samp("ret").over(last(w, 20)), zero),
            "divergence": price_volume_divergence("ret", "volume_change", w),
        }
    )
    whole = rows.groupBy(key).agg(F.stddev_samp("ret").alias("_sd"))
    limit = 2 * F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(0.01)
    flags = {"hv_ratio": F.col("hv5") / (F.col("hv20") + 1e-8), "is_jump": (F.col("ret") > limit).cast("double"), "is_crash": (F.col("ret") < -limit).cast("double")}
    return rows.join(whole, key).withColumns(flags).drop("_sd")


#: How scaled_block() bounds each feature of volatility_block(): limits, then a divisor.
BLOCK_SCALES = {name: (-1.0, 1.0, 1.0) for name in ("ret", "abs_ret", "sign_ret", "gap", "volume_change", "divergence")} | {name: (0.0, 2.0, 2.0) for name in ("range_ratio", "hv5", "hv20", "hv_ratio")} | {name: (0.0, 1.0, 1.0) for name in ("is_jump", "is_crash")}


def scaled_block(df: DataFrame) -> DataFrame:
    """The features of volatility_block() clipped and scaled, as one array column; what isn't finite becomes 0."""

    def bounded(name: str, low: float, high: float, over: float) -> Column:
        x = F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
        return F.greatest(F.least(x, F.lit(high)), F.lit(low)) / over

    return df.withColumn("block", F.array(*[bounded(n, *s) for n, s in BLOCK_SCALES.items()]))


def overbought_signals(rsi: Column, mfi: Column, up: Column, down: Column) -> dict[str, Column]:
    """Signals of the current RSI, MFI and Aroon values, and the telling ones joined."""

    def band(c: Column, low: float, high: float) -> Column:
        return F.when(c >= high, "超买").when(c <= low, "超卖").when(c.isNotNull(), "中性")

    a = F.when((up >= 70) & (down <= 30), "强势").when((down >= 70) & (up <= 30), "弱势").when(up > down, "偏多").when(up.isNotNull() & down.isNotNull(), "偏空")
    r, m = band(rsi, 30, 70), band(mfi, 20, 80)
    told = F.concat_ws(", ", F.when(r != "中性", F.concat(F.lit("RSI"), r)), F.when(m != "中性", F.concat(F.lit("MFI"), m)), F.concat(F.lit("Aroon"), a))
    return {"rsi_signal": r, "mfi_signal": m, "aroon_signal": a, "combined": F.coalesce(F.nullif(told, F.lit("")), F.lit("中性"))}


def sequences(df: DataFrame, columns: list[str], length: int = 60, ahead: int = 5, price: str = "close", key: str = KEY, date: str = DATE) -> DataFrame:
    """A row for each day with `length` days before it and `ahead` after: features, forward returns, direction."""
    w = window(key, date)
    before = F.collect_list(F.array(*columns)).over(w.rowsBetween(-length, -1))
    moves = [divide(F.lead(price, i).over(w), (F.lead(price, i - 1) if i > 1 else F.lead(price, 0)).over(w)) - 1 for i in range(1, ahead + 1)]
    rows = df.select(key, date, before.alias("features"), F.array(*moves).alias("forward"), (F.lead(price, ahead).over(w) > F.col(price)).cast("int").alias("direction"))
    return rows.where((F.size("features") == length) & F.col("direction").isNotNull())


def z_score(df: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """(x - mean) / (population deviation + 1e-8) by key; gaps become 0."""
    sums = df.groupBy(key).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = df.join(sums, key)
    return rows.withColumns({c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8), F.lit(0.0)) for c in columns}).select(*df.columns)


def normalise(df: DataFrame, c: str, how: str = "zscore", key: str = KEY, date: str = DATE) -> Column:
    """A column normalised over its key: zscore (flat: x - mean), minmax (flat: 0.5) or first (0: x)."""
    whole = Window.partitionBy(key)
    if how == "zscore":
        m, s = F.avg(c).over(whole), F.stddev_pop(c).over(whole)
        return F.when(s == 0, F.col(c) - m).otherwise(divide(F.col(c) - m, s))
    if how == "minmax":
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return F.when(high == low, 0.5).otherwise(divide(F.col(c) - low, high - low))
    if how == "first":
        first = F.first(c).over(window(key, date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.when(first == 0, F.col(c)).otherwise(divide(F.col(c), first))
    raise ValueError(f"unknown method {how!r}")


def period_returns(df: DataFrame, periods: dict[str, int], price: str = "close", key: str = KEY, date: str = DATE) -> DataFrame:
    """For each key and period of n rows: last price over that n rows from the end (or the first, if fewer), less 1."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))
    rows = df.withColumns({"_back": back, "_n": F.count("*").over(Window.partitionBy(key))})
    at = [F.max(F.when(F.col("_back") == F.least(F.lit(n), F.col("_n")), F.col(price))).alias(f"_{name}") for name, n in periods.items()]
    ends = rows.groupBy(key).agg(F.max(F.when(F.col("_back") == 1, F.col(price))).alias("_last"), *at)
    return ends.select(key, *[(divide(F.col("_last"), F.col(f"_{name}")) - 1).alias(name) for name in periods])


def phase_space(df: DataFrame, c: str, lag: int = 1, dims: int = 2, key: str = KEY, date: str = DATE) -> DataFrame:
    """Delay embedding: x0 .. x(dims - 1), each lag rows later; rows without all of them go."""
    w = window(key, date)
    rows = df.select(key, date, *[F.lead(c, i * lag).over(w).alias(f"x{i}") for i in range(dims)])
    return rows.where(F.col(f"x{dims - 1}").isNotNull())
