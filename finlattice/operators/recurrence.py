"""Exponential averages and the indicators built on them.

e(t) = a x(t) + (1 - a) e(t-1) has no window form that is stable on long series.  with_recurrences()
brings a key's rows together in date order and runs them through one vector loop: for instruments
of some thousand rows, where keys spread over tasks.  spread_recurrences() gives the same numbers
for histories of any length: what a stretch of rows does to the averages before it is an affine
map, so stretches are reduced side by side, their maps composed in order, and each stretch finished from
the state that it begins with (a parallel prefix sum of maps).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import unused, written
from .series import change, deviation, mean, window


def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def span(n: float) -> float:
    return 2.0 / (n + 1)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's averages, begun at 0; nothing where no loss has occurred."""
    move = np.diff(close, prepend=close[:1]) if len(close) else close
    gain, loss = ema(np.maximum(move, 0), 1 / n), ema(np.maximum(-move, 0), 1 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, np.nan, 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss)))


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(close, span(fast)) - ema(close, span(slow))
    smooth = ema(line, span(signal))
    return line, smooth, line - smooth


def _names(emas: tuple[int, ...], rsis: tuple[int, ...], macds: tuple[tuple[int, int, int], ...]) -> list[str]:
    names = [f"ema_{n}" for n in emas] + [f"rsi_{n}" for n in rsis]
    for i in range(len(macds)):
        end = "" if i == 0 else f"_{i + 1}"
        names += [f"macd{end}", f"macd_signal{end}", f"macd_hist{end}"]
    return names


def with_recurrences(df: DataFrame, price: str = "close", emas: tuple[int, ...] = (), rsis: tuple[int, ...] = (14,), macds: tuple[tuple[int, int, int], ...] = ((12, 26, 9),), key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """(key, date) with ema_n, rsi_n, and macd, macd_signal and macd_hist (numbered after the first)."""
    names = _names(emas, rsis, macds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        x = pdf[price].to_numpy(float)
        values = [ema(x, span(n)) for n in emas] + [rsi(x, n) for n in rsis] + [v for m in macds for v in macd(x, *m)]
        out = pdf[[key, date]].copy()
        for name, v in zip(names, values, strict=True):
            out[name] = pd.Series(v, index=out.index).astype("Float64") if np.isnan(v).any() else v
        return out

    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {date} {kinds[date]}, " + ", ".join(f"{n} double" for n in names)
    return df.select(key, date, price).groupBy(key).applyInPandas(run, schema)


def _carried(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """The average of x after a state."""
    return ema(np.concatenate([[before], x]), alpha)[1:]


class _Stretch:
    """The averages of a stretch: emas, then (gain, loss) of each rsi, then (fast, slow, signal) of each macd."""

    def __init__(self, emas: tuple[int, ...], rsis: tuple[int, ...], macds: tuple[tuple[int, int, int], ...]):
        self.emas, self.rsis, self.macds = emas, rsis, macds
        self.size = len(emas) + 2 * len(rsis) + 3 * len(macds)

    def begin(self, first: float) -> np.ndarray:
        """The state before a series."""
        return np.array([first] * len(self.emas) + [0.0, 0.0] * len(self.rsis) + [first, first, 0.0] * len(self.macds))

    def run(self, x: np.ndarray, move: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        """All averages, row by row."""
        s, out = iter(state), [_carried(x, span(n), b) for n, b in zip(self.emas, state, strict=False)]
        for _ in self.emas:
            next(s)
        for n in self.rsis:
            out += [_carried(part, 1 / n, next(s)) for part in (np.maximum(move, 0), np.maximum(-move, 0))]
        for fast, slow, signal in self.macds:
            f, w = _carried(x, span(fast), next(s)), _carried(x, span(slow), next(s))
            out += [f, w, _carried(f - w, span(signal), next(s))]
        return out

    def columns(self, averages: list[np.ndarray]) -> list[np.ndarray]:
        """ema, rsi, macd, signal and difference, as with_recurrences() names them."""
        k = len(self.emas)
        out = averages[:k]
        for gain, loss in zip(averages[k : k + 2 * len(self.rsis) : 2], averages[k + 1 : k + 2 * len(self.rsis) : 2], strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                out = [*out, np.where(loss == 0, np.nan, 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss)))]
        for i in range(k + 2 * len(self.rsis), self.size, 3):
            line = averages[i] - averages[i + 1]
            out = [*out, line, averages[i + 2], line - averages[i + 2]]
        return out


def spread_recurrences(df: DataFrame, price: str = "close", emas: tuple[int, ...] = (), rsis: tuple[int, ...] = (14,), macds: tuple[tuple[int, int, int], ...] = ((12, 26, 9),), key: str = "symbol", date: str = "bar_date", parts: int | None = None) -> DataFrame:
    """with_recurrences() for long histories: ranges of (key, date) are dealt over `parts` tasks, so one key's rows are too.

    Rows without a price or a date are left out.  The rows are written once; a row for each key and range it has
    rows in goes through one task a key.
    """
    spark, work = df.sparkSession, _Stretch(emas, rsis, macds)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    own, kept = unused(df, "_stretch"), df.where(F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double")) & F.col(date).isNotNull())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.select(key, date, F.col(price).cast("double").alias("x")).repartitionByRange(parts, key, date)
    rows = written(ranged.withColumn(own, F.spark_partition_id()), "stretches")

    def reduce_(pdf: pd.DataFrame) -> pd.DataFrame:
        """The map of a stretch: end = matrix @ begin + vector, its first move left out."""
        x = pdf.sort_values(date).x.to_numpy()
        move, still = np.diff(x, prepend=x[:1]), np.zeros(len(x))
        last = lambda made: [a[-1] for a in made]
        vector = last(work.run(x, move, np.zeros(work.size)))
        matrix = np.column_stack([last(work.run(still, still, unit)) for unit in np.eye(work.size)]) if work.size else np.zeros((0, 0))
        return pd.DataFrame({key: [pdf[key].iloc[0]], own: [pdf[own].iloc[0]], "n": [len(x)], "first": [x[0]], "last": [x[-1]], "vector": [vector], "matrix": [matrix.ravel().tolist()]})

    maps = rows.groupBy(key, own).applyInPandas(reduce_, f"`{key}` {kinds[key]}, `{own}` int, n long, first double, last double, vector array<double>, matrix array<double>")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each stretch of a key begins with."""
        state, before, begins, out = None, None, [], pdf.sort_values(own)
        for s in out.itertuples():
            state, before = (work.begin(s.first), s.first) if state is None else (state, before)
            begins.append((state.tolist(), before))
            end = np.array(s.matrix).reshape(work.size, work.size) @ state + np.array(s.vector)
            for i, n in enumerate(rsis):  # the move between two stretches
                for j, move in enumerate((max(s.first - before, 0.0), max(before - s.first, 0.0))):
                    end[len(emas) + 2 * i + j] += move / n * (1 - 1 / n) ** (s.n - 1)
            state, before = end, s.last
        return pd.DataFrame({key: out[key], own: out[own], "begin": [b for b, _ in begins], "before": [p for _, p in begins]})

    begins = written(maps.groupBy(key).applyInPandas(scan, f"`{key}` {kinds[key]}, `{own}` int, begin array<double>, before double"), "stretch-begins")
    names = _names(emas, rsis, macds)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf = left.sort_values(date)
        x = pdf.x.to_numpy()
        move = np.diff(x, prepend=right.before.iloc[0])
        out = pdf[[key, date]].copy()
        for name, v in zip(names, work.columns(work.run(x, move, np.array(right.begin.iloc[0]))), strict=True):
            out[name] = pd.Series(v, index=out.index).astype("Float64") if np.isnan(v).any() else v
        return out

    schema = f"`{key}` {kinds[key]}, `{date}` {kinds[date]}, " + ", ".join(f"{n} double" for n in names)
    return rows.groupBy(key, own).cogroup(begins.groupBy(key, own)).applyInPandas(finish, schema)


# The columns of fund_features(), in the order of its sequences.
FUND_FEATURES = ("return", "rsi", "macd", "macd_signal", "macd_hist", "bb_position", "volatility", "ma_ratio_5_20")


def fund_features(df: DataFrame, price: str = "unit_nav", key: str = "symbol", date: str = "nav_date", daily: str | None = None) -> DataFrame:
    """(key, date) and FUND_FEATURES of a fund's values; volatility in percent, of the column `daily` if given, else of returns."""
    w = window(key, date)
    rows = df.withColumn("return", change(price, w)).withColumn("_daily", F.col(daily) if daily else F.col("return"))
    mid, spread = mean(price, w, 20), deviation(price, w, 20)
    lower, upper = mid - 2 * spread, mid + 2 * spread
    made = {"bb_position": (F.col(price) - lower) / (upper - lower + 1e-8), "volatility": deviation("_daily", w, 20) * 100, "ma_ratio_5_20": mean(price, w, 5) / (mid + 1e-8)}
    rows = rows.select(key, date, "return", *[c.alias(name) for name, c in made.items()])
    waves = with_recurrences(df, price, key=key, date=date).withColumnRenamed("rsi_14", "rsi")
    return rows.join(waves, [key, date]).select(key, date, *FUND_FEATURES)


def fund_sequences(features: DataFrame, length: int = 5, key: str = "symbol", date: str = "nav_date") -> DataFrame:
    """(key, date, features, next_return, direction): `length` rows of features before each day, and what its return was."""
    w = window(key, date)
    before = F.collect_list(F.array(*FUND_FEATURES)).over(w.rowsBetween(-length, -1))
    rows = features.select(key, date, before.alias("features"), F.col("return").alias("next_return"), F.coalesce(F.col("return") > 0, F.lit(False)).cast("int").alias("direction"))
    return rows.where(F.size("features") == length)
