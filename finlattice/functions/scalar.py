"""Column expressions: safe casts, security codes, JSON tags, calendar rules."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def safe_double(c: Column) -> Column:
    """A number, or null for text that is none and for NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_date(c: Column) -> Column:
    """A date from yyyy-MM-dd or yyyyMMdd, or null."""
    text = c.cast("string")
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def is_a_share(code: Column) -> Column:
    return code.rlike(r"^\d{6}$")


def is_hk_share(code: Column) -> Column:
    return code.rlike(r"^\d{5}(\.HK)?$")


def market_of(code: Column) -> Column:
    return F.when(is_hk_share(code), "hk").otherwise("a")


def clamp_dates(start: Column, end: Column, today: Column, days: int = 365) -> tuple[Column, Column]:
    """End no later than today, start no later than end; defaults: today and `days` before the end."""
    last = F.least(F.coalesce(end, today), today)
    return F.least(F.coalesce(start, F.date_sub(last, days)), last), last


def has_tag(tags: Column, tag: str) -> Column:
    """Whether a JSON list of texts holds the tag."""
    return F.coalesce(F.array_contains(F.from_json(tags, "array<string>"), tag), F.lit(False))


def correlation(a: str | Column, b: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the rows that have both, null where one of them doesn't vary.

    Spark's own corr() raises an error there in ANSI mode.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(over) for p in parts] if over is not None else parts
    return cov / F.nullif(sx * sy, F.lit(0.0))


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def last_business_day(day: Column, quarter: bool = False) -> Column:
    """Whether the day is the last weekday of its month (of a quarter's month)."""
    end = F.last_day(day)
    back = F.greatest(F.weekday(end) - 4, F.lit(0))
    is_last = day == F.date_sub(end, back)
    return is_last & (F.month(day) % 3 == 0) if quarter else is_last


def next_fetch(ts: Column, hours: int = 4) -> Column:
    return ts + F.expr(f"INTERVAL {hours} HOURS")


def business_days(start: Column, n: int) -> Column:
    """The n weekdays after start, as an array."""
    days = F.sequence(F.date_add(start, 1), F.date_add(start, 7 * (n // 5 + 2)))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)


def first_json(reply: Column, schema: str) -> Column:
    """The first flat {...} in a text, parsed; null fields where it is none."""
    return F.from_json(F.regexp_extract(reply, r"(\{[^{}]*\})", 1), schema)
