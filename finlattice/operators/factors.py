"""The factor panel: one row for each key and day, about two hundred window columns.

Columns come from rules over period lists.  All windows share one partitioning and order, so the
panel is one shuffle, one sort and a chain of Window operators; the exponential averages are the
only part that runs in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import divide
from .recurrence import with_recurrences
from .series import change, fill, last, running_sum, true_range, typical, window

TINY = 1e-10


# The periods of the factor library, which its column names are made of.
@dataclass(frozen=True)
class Periods:
    rsi: tuple[int, ...] = (5, 6, 8, 10, 12, 14, 16, 20, 24)
    change: tuple[int, ...] = (2, 3, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 60, 90, 120)
    volatility: tuple[int, ...] = (5, 8, 10, 12, 15, 20, 25, 30, 40, 60)
    bollinger: tuple[int, ...] = (8, 10, 12, 15, 20, 25, 30)
    average: tuple[int, ...] = (5, 8, 10, 12, 15, 20, 25, 30, 40, 60)
    true_range: tuple[int, ...] = (7, 14, 21, 28)
    volume: tuple[int, ...] = (5, 10, 15, 20, 30)
    aroon: tuple[int, ...] = (14, 20, 25)
    money_flow: tuple[int, ...] = (14, 8, 10, 12, 20, 24)
    quality: tuple[int, ...] = (10, 15, 20, 25, 30, 40, 60)
    sentiment: tuple[int, ...] = (3, 5, 6, 8, 10, 12, 15, 20)
    levels: tuple[int, ...] = (10, 20, 30, 60)
    turnover: tuple[int, ...] = (5, 10, 15, 20)
    macd_pairs: tuple[tuple[int, int], ...] = ((6, 19), (8, 21), (10, 22), (12, 26))


class Windows:
    """The window values that factors are made of, each asked of Spark once however many factors use it."""

    KINDS = {"count": F.count, "avg": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max, "min": F.min, "list": F.collect_list}

    def __init__(self, w: WindowSpec):
        self.w = w
        self.made: dict[str, Column] = {}

    def get(self, kind: str, c: str, n: int) -> Column:
        name = f"_{kind}_{c}_{n}"
        self.made[name] = F.lag(c, n).over(self.w) if kind == "lag" else self.KINDS[kind](c).over(last(self.w, n))
        return F.col(name)

    def full(self, value: Column, c: str, n: int) -> Column:
        return F.when(self.get("count", c, n) == n, value)

    def mean(self, c: str, n: int) -> Column:
        return self.full(self.get("avg", c, n), c, n)

    def deviation(self, c: str, n: int) -> Column:
        return self.full(self.get("std", c, n), c, n)

    def change(self, c: str, n: int) -> Column:
        return divide(F.col(c), self.get("lag", c, n)) - 1

    def aroon(self, c: str, n: int, top: bool) -> Column:
        place = F.array_position(self.get("list", c, n), self.get("max" if top else "min", c, n))
        return self.full(place.cast("double") / n * 100, c, n)


def _gap(c: str, w: Windows, n: int) -> Column:
    """Relative distance from the mean of n rows."""
    m = w.mean(c, n)
    return (F.col(c) - m) / (m + TINY)


def _momentum(p: Periods, w: Windows) -> dict[str, Column]:
    out = {f"momentum_{kind}_{n}": w.change("close", n) for n in p.change for kind in ("roc", "ret")}
    out |= {f"momentum_ma_ratio_{n}": _gap("close", w, n) for n in p.average}
    for n in p.aroon:
        out |= {f"aroon_up_{n}": w.aroon("high", n, True), f"aroon_down_{n}": w.aroon("low", n, False)}
    up, down = w.aroon("high", 20, True), w.aroon("low", 20, False)
    return out | {"aroon_up": up, "aroon_down": down, "aroon_osc": up - down}


def _volatility(p: Periods, w: Windows) -> dict[str, Column]:
    out = {f"volatility_{n}": w.deviation("_ret", n) * F.sqrt(F.lit(252.0)) for n in p.volatility}
    out |= {f"atr_{n}": w.mean("_tr", n) for n in p.true_range} | {"atr_pct": w.mean("_tr", 14) / (F.col("close") + TINY)}
    for n in p.bollinger:
        mid, spread = w.mean("close", n), 2 * w.deviation("close", n)
        upper, lower = mid + spread, mid - spread
        out |= {f"bb_upper_{n}": upper, f"bb_lower_{n}": lower, f"bb_mid_{n}": mid, f"bb_width_{n}": (upper - lower) / (mid + TINY), f"bb_position_{n}": (F.col("close") - mid) / (upper - lower + TINY)}
    return out


def _volume(p: Periods, w: Windows) -> dict[str, Column]:
    out = {"obv": F.col("_obv")}
    for n in p.volume:
        out[f"obv_ratio_{n}"] = F.col("_obv") / (F.abs(w.mean("_obv", n)) + TINY)
        out[f"volume_ratio_{n}"] = F.col("volume") / (w.mean("volume", n) + TINY)
        out[f"volume_std_ratio_{n}"] = F.col("volume") / (w.deviation("volume", n) + TINY)
    for n in p.money_flow:
        ratio = divide(w.get("sum", "_up", n), w.get("sum", "_down", n))
        out[f"mfi_{n}"] = w.full(100 - 100 / (1 + ratio), "_up", n)
    return out


def _proxies(p: Periods, w: Windows) -> dict[str, Column]:
    """Stand-ins for value, quality and mood."""
    out: dict[str, Column] = {}
    for n in p.quality:
        out |= {f"pv_ratio_{n}": F.col("_pv") / (w.mean("_pv", n) + TINY), f"return_vol_{n}": w.deviation("_ret", n)}
    for n in p.sentiment:
        out |= {f"sentiment_ret_{n}": w.mean("_ret", n), f"sentiment_vol_{n}": _gap("volume", w, n)}
    return out


def _shape(p: Periods, w: Windows) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in p.average:
        out |= {f"close_ma_{n}": w.mean("close", n), f"close_to_ma_{n}": _gap("close", w, n)}
    for n in p.levels:
        out |= {f"close_high_{n}": F.col("close") / w.full(w.get("max", "high", n), "high", n), f"close_low_{n}": F.col("close") / w.full(w.get("min", "low", n), "low", n)}
    spread, body = F.col("high") - F.col("low"), F.col("close") - F.col("open")
    return out | {"range_hl": spread / (F.col("close") + TINY), "range_oc": body / (F.col("open") + TINY), "body_ratio": F.abs(body) / (spread + TINY)}


def _optional(p: Periods, w: Windows, columns: list[str]) -> dict[str, Column]:
    """Turnover where the bars have it; percent changes from the bars, or else from returns."""
    out: dict[str, Column] = {}
    if "turnover_rate" in columns:
        for n in p.turnover:
            out |= {f"turnover_ma_{n}": w.mean("turnover_rate", n), f"turnover_std_{n}": w.deviation("turnover_rate", n)}
        out["turnover"] = F.col("turnover_rate")
    given = "change_pct" in columns
    for n in (3, 5, 10, 15, 20) if given else (3, 15):
        out[f"change_pct_cum_{n}"] = w.full(w.get("sum", "_pct", n), "_pct", n)
    return out | {"change_pct": F.col("_pct")}


def factor_columns(p: Periods, w: Windows, columns: list[str]) -> dict[str, dict[str, Column]]:
    """The window columns by category."""
    return {"momentum": _momentum(p, w), "volatility": _volatility(p, w), "volume": _volume(p, w), "proxies": _proxies(p, w), "shape": _shape(p, w), "optional": _optional(p, w, columns)}


def factor_panel(df: DataFrame, p: Periods = Periods(), key: str = "symbol", date: str = "bar_date", filled: bool = False, look_ahead: bool = False, with_python: bool = True) -> DataFrame:
    """(key, date, close, factors).

    filled: gaps take the value before them, then 0; look_ahead: before that, leading gaps take the
    first value after them, as charts do and models must not.
    """
    w = window(key, date)
    before = F.lag("close").over(w)
    base = df.withColumns({"_ret": change("close", w), "_tr": true_range(w), "_pv": F.col("close") / (F.col("volume") + 1), "_tp": typical(), "_signed": F.coalesce(F.signum(F.col("close") - before), F.lit(0.0)) * F.col("volume")})
    move, flow = F.col("_tp") - F.lag("_tp").over(w), F.col("_tp") * F.col("volume")
    base = base.withColumns({"_obv": running_sum("_signed", w), "_up": F.when(move > 0, flow).otherwise(0.0), "_down": F.when(move < 0, flow).otherwise(0.0), "_pct": F.col("change_pct") if "change_pct" in df.columns else F.col("_ret") * 100})
    windows = Windows(w)
    columns = {name: c for group in factor_columns(p, windows, df.columns).values() for name, c in group.items()}
    panel = base.select("*", *[c.alias(name) for name, c in windows.made.items()]).select(key, date, "close", *[c.alias(name) for name, c in columns.items()])
    if with_python:
        macds = ((12, 26, 9), *[(fast, slow, 9) for fast, slow in p.macd_pairs])
        waves = with_recurrences(df, rsis=p.rsi, macds=macds, key=key, date=date)
        hist = [F.col(f"macd_hist_{i}").alias(f"macd_hist_{fast}_{slow}") for i, (fast, slow) in enumerate(p.macd_pairs, 2)]
        waves = waves.select(key, date, *[f"rsi_{n}" for n in p.rsi], F.col("macd").alias("macd_line"), "macd_signal", "macd_hist", *hist)
        panel = panel.join(waves, [key, date])
    if filled:
        names = [c for c in panel.columns if c not in (key, date, "close")]
        panel = panel.withColumns({c: fill(c, w, backward=look_ahead) for c in names})
    return panel


def catalogue(p: Periods = Periods(), columns: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Factor names by category; needs an active session."""
    groups = {k: list(v) for k, v in factor_columns(p, Windows(window()), list(columns)).items()}
    return groups | {"oscillators": [f"rsi_{n}" for n in p.rsi] + ["macd_line", "macd_signal", "macd_hist"] + [f"macd_hist_{a}_{b}" for a, b in p.macd_pairs]}
