"""Distribution, dependence and factor statistics by key."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation, divide
from ..scratch import written
from .kernels import by_key
from .rolling import window_correlations
from .series import last, window


def basic_stats(df: DataFrame, c: str, key: str = "symbol") -> DataFrame:
    """Mean, sample deviation, biased skewness and excess kurtosis, and Jarque-Bera with its p value."""
    s, k, n = F.col("skewness"), F.col("kurtosis"), F.col("n")
    sums = df.where(F.col(c).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))
    jb = n / 6 * (s * s + k * k / 4)
    return sums.withColumn("jarque_bera", jb).withColumn("jb_p_value", F.exp(-F.col("jarque_bera") / 2))


def overview(df: DataFrame, price: str = "close", key: str = "symbol", date: str = "bar_date") -> DataFrame:
    sums = df.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"), F.min_by(price, date).alias("first_price"), F.max_by(price, date).alias("last_price"), F.max(price).alias("max_price"), F.min(price).alias("min_price"), F.avg(price).alias("mean_price"), F.stddev_samp(price).alias("std_price"))
    return sums.withColumn("change_pct", (divide(F.col("last_price"), F.col("first_price")) - 1) * 100)


def autocorrelation(df: DataFrame, c: str, lags: int = 40, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """(key, lag, acf), the biased estimate; a row of sums for each lag, no pairs of rows."""
    w = window(key, date)
    means = df.where(F.col(c).isNotNull()).groupBy(key).agg(F.avg(c).alias("_m"), F.var_pop(c).alias("_v"), F.count("*").alias("_n"))
    rows = df.where(F.col(c).isNotNull()).join(means, key).withColumn("_x", F.col(c) - F.col("_m"))
    sums = rows.select(key, "_x", "_v", "_n", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = sums.groupBy(key).agg(F.first("_v").alias("_v"), F.first("_n").alias("_n"), *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(1, lags + 1)]))
    return sums.select(key, "_v", "_n", stack.alias("p")).where("p.lag < _n").select(key, "p.lag", divide(F.col("p.s"), F.col("_v") * F.col("_n")).alias("acf"))


def hurst(df: DataFrame, c: str, key: str = "symbol", date: str = "bar_date", first_lag: int = 10, most_lag: int | None = None) -> DataFrame:
    """(key, hurst, r2) by rescaled range: mean range over deviation of the chunks of each length, log-log slope.

    Chunk lengths run from first_lag to a quarter of the rows; a remainder is dropped, chunks
    without variance are skipped, and fewer than 3 lengths give null.
    """

    def slope(x: np.ndarray) -> list[tuple]:
        top = len(x) // 4 if most_lag is None else min(len(x) // 4, most_lag)
        points = []
        for n in range(first_lag, top + 1):
            chunks = x[: len(x) // n * n].reshape(-1, n)
            walk = np.cumsum(chunks - chunks.mean(axis=1, keepdims=True), axis=1)
            spread, deviation = walk.max(axis=1) - walk.min(axis=1), chunks.std(axis=1, ddof=1)
            ok = (deviation > 0) & (spread > 0)
            if ok.any():
                points.append((math.log(n), math.log((spread[ok] / deviation[ok]).mean())))
        if len(points) < 3:
            return [(None, None)]
        a, b = np.array(points).T
        sxx, sxy, syy = ((a - a.mean()) ** 2).sum(), ((a - a.mean()) * (b - b.mean())).sum(), ((b - b.mean()) ** 2).sum()
        return [(sxy / sxx, sxy**2 / (sxx * syy) if syy else 1.0)]

    return by_key(df, slope, "hurst double, r2 double", c, key, date)


def ranked_values(rows: DataFrame, c: str, by: list[str]) -> DataFrame:
    """(by, c, n, below): each distinct value with the number of its rows and of those with smaller values.

    Values are counted, dealt into ranges and numbered range by range, so no task sorts a whole group.
    """
    counts = rows.groupBy(*by, c).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(parts, *by, c).withColumn("_part", F.spark_partition_id()), "ranked-values")
    order = Window.partitionBy(*by).orderBy("_part")
    before = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("_n")).withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")  # a row a range
    inside = F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(c)) - F.col("n")
    return dealt.withColumn("_inside", inside).join(before, [*by, "_part"]).select(*by, c, "n", (F.col("_before") + F.col("_inside")).alias("below"))


def with_average_rank(rows: DataFrame, c: str, by: list[str], into: str) -> DataFrame:
    """rows with ranks from 1 where ties share their mean rank."""
    ranks = ranked_values(rows, c, by).select(*by, c, (F.col("below") + (F.col("n") + 1) / 2).alias(into))
    return rows.join(ranks, [*by, c])


def long_factors(panel: DataFrame, factors: list[str], forward: str, key: str = "symbol", date: str = "bar_date", gaps: bool = False) -> DataFrame:
    """(key, date, factor, value, forward): finite pairs only, or with gaps all rows with a forward value, other values null."""
    rows = panel.unpivot([key, date, forward], [F.col(f).cast("double").alias(f) for f in factors], "factor", "value")
    ok = F.col("value").isNotNull() & F.col(forward).isNotNull() & ~F.isnan("value") & ~F.isnan(F.col(forward)) & (F.abs("value") < float("inf"))
    if gaps:
        rows, ok = rows.withColumn("value", F.when(ok, F.col("value"))), F.col(forward).isNotNull() & ~F.isnan(F.col(forward))
    return rows.where(ok).withColumnRenamed(forward, "forward")


def information_coefficients(rows: DataFrame, least: int = 10, by: tuple[str, ...] = ("factor",)) -> DataFrame:
    """Pearson and rank IC of each factor; null below `least` pairs."""
    by = list(by)
    rows = written(rows.select(*by, "value", "forward"), "factor-rows")
    ranked = with_average_rank(with_average_rank(rows, "value", by, "_rv"), "forward", by, "_rf")
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("value", "forward").alias("ic"), correlation("_rv", "_rf").alias("rank_ic"))
    return sums.select(*by, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("ic", "rank_ic")])


def rolling_ic(rows: DataFrame, n: int = 20, least: int = 10, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """Mean, deviation and ratio of the IC and the rank IC of each factor over rolling windows.

    rows: long_factors() with gaps.  A window is n dates in a row that have a forward value, the last n
    left out; below `least` finite pairs, or without spread, it has no IC.
    """

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        ic, rank_ic = window_correlations(pdf.value.to_numpy(float), pdf.forward.to_numpy(float), n, least)
        return pd.DataFrame({"factor": pdf.factor.iloc[0], "ic": ic, "rank_ic": rank_ic})

    each = rows.select("factor", key, date, "value", "forward").groupBy("factor", key).applyInPandas(windows, "factor string, ic double, rank_ic double")  # one instrument's history
    each = each.select("factor", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("ic", "rank_ic")])
    out = each.groupBy("factor").agg(*[f(c).alias(f"{c}_{name}") for c in ("ic", "rank_ic") for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))])
    return out.withColumns({f"{c}_ir": F.col(f"{c}_mean") / (F.col(f"{c}_std") + 1e-10) for c in ("ic", "rank_ic")})


def group_returns(rows: DataFrame, groups: int = 5) -> DataFrame:
    """Mean forward return of each factor's quantile groups, and the top less the bottom.

    Groups are half-open between interpolated percentiles, the last one closed; factors with fewer
    than 2 * groups rows have none.
    """
    rows = written(rows.select("factor", "value", "forward"), "factor-rows")
    ranked = ranked_values(rows, "value", ["factor"])
    sizes = rows.groupBy("factor").agg(F.count("*").alias("_n")).where(F.col("_n") >= 2 * groups)
    # the places, counted from 0, that each percentile lies between
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(i / groups) * (F.col("_n") - 1)).alias("p")) for i in range(1, groups)]))
    places = sizes.select("factor", places.alias("s")).select("factor", "s.i", F.floor("s.p").alias("low"), (F.col("s.p") - F.floor("s.p")).alias("part"))
    holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
    met = ranked.join(F.broadcast(places), "factor").where(holds(F.col("low")) | holds(F.col("low") + 1))  # groups - 1 rows a factor
    ends = met.groupBy("factor", "i").agg(F.max(F.when(holds(F.col("low")), F.col("value"))).alias("a"), F.max(F.when(holds(F.col("low") + 1), F.col("value"))).alias("b"), F.max("part").alias("part"))
    cut = ends.select("factor", "i", F.when((F.col("part") == 0) | F.col("b").isNull(), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")).alias("e"))
    edges = cut.groupBy("factor").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("_e"))
    placed = rows.join(F.broadcast(edges), "factor").withColumn("bucket", F.size(F.filter("_e", lambda e: e <= F.col("value"))) + 1)  # a row a factor
    means = placed.groupBy("factor").pivot("bucket", list(range(1, groups + 1))).agg(F.avg("forward"))
    out = means.withColumnsRenamed({str(i): f"group_{i}" for i in range(1, groups + 1)})
    return out.withColumn("long_short", F.col(f"group_{groups}") - F.col("group_1"))


def factor_turnover(panel: DataFrame, factors: list[str], top: float = 0.2, rows_back: int = 1, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """1 - Jaccard similarity of a row's top factors (by value, across columns) and those rows_back before.

    Top are the factors at or above the interpolated percentile 1 - top of the row's values; nulls and
    NaN have no place in it.  Two rows without any value share nothing.
    """
    pairs = F.filter(F.array(*[F.struct(F.col(f).cast("double").alias("v"), F.lit(f).alias("f")) for f in factors]), lambda p: p["v"].isNotNull() & ~F.isnan(p["v"]))
    rows = panel.select(key, date, pairs.alias("pairs")).withColumn("values", F.array_sort(F.transform("pairs", lambda p: p["v"])))
    place = (1 - top) * (F.size("values") - 1)
    low, part = F.floor(place).cast("int"), place - F.floor(place)
    a, b = F.get("values", low), F.coalesce(F.get("values", low + 1), F.get("values", low))
    rows = rows.withColumn("edge", F.when(part < 0.5, a + (b - a) * part).otherwise(b - (b - a) * (1 - part)))
    rows = rows.select(key, date, F.transform(F.filter("pairs", lambda p: p["v"] >= F.col("edge")), lambda p: p["f"]).alias("top"))
    rows = rows.withColumn("before", F.lag("top", rows_back).over(window(key, date)))
    same = F.size(F.array_intersect("top", "before")) / (F.size(F.array_union("top", "before")) + 1e-10)
    return rows.where("before IS NOT NULL").select(key, date, (1 - same).alias("turnover"))


def correlation_or_zero(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, corr): 0 for features without variance."""
    sums = df.agg(*[F.when(F.stddev_pop(f) < 1e-12, 0.0).otherwise(F.coalesce(correlation(f, target), F.lit(0.0))).alias(f) for f in features])
    return sums.unpivot([], [F.col(f) for f in features], "feature", "corr")


def flatness(df: DataFrame, predicted: str, actual: str, mean_abs_corr: Column | float = 1.0, parameters: int = 10_000) -> DataFrame:
    """Signs of a flat prediction: low deviation ratio, weak features, small model."""
    ratio = divide(F.stddev_pop(predicted), F.stddev_pop(actual))
    c = F.lit(mean_abs_corr) if not isinstance(mean_abs_corr, Column) else mean_abs_corr
    return df.agg(ratio.alias("std_ratio"), (ratio < 0.3).alias("is_flat"), (c < 0.2).alias("weak_features"), F.lit(parameters < 10_000).alias("small_model"), (1 - F.least(F.lit(1.0), F.abs(1 - ratio))).alias("volatility_match"))


def interpret_hurst(h: Column) -> Column:
    return F.when(h.isNull(), "unknown").when(h > 0.55, "trending").when(h < 0.45, "mean reverting").otherwise("random walk")


def interpret_entropy(e: Column) -> Column:
    return F.when(e.isNull(), "unknown").when(e < 1.0, "regular").when(e > 2.0, "complex").otherwise("moderate")
