"""Filtered scans, paging, latest rows and counts.  `as_of` replaces the current date everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_scan(df: DataFrame, keys: list[str] | None = None, start: str | None = None, end: str | None = None, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """Rows of some keys between two dates (both included); every filter reaches the scan."""
    if keys is not None:
        df = df.where(F.col(key).isin(keys))
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 500) -> DataFrame:
    """A page of ordered rows; sizes are held between 1 and `most`."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> int:
    return math.ceil(df.count() / size)


def last_n(df: DataFrame, n: int, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(date))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def since_days(df: DataFrame, days: int, as_of: str, date: str = "bar_date", only: dict | None = None, strict: bool = False) -> DataFrame:
    """Rows of the last `days` days.

    only: {column: value}; where a value is given, the days are ignored unless strict.
    """
    chosen = {c: v for c, v in (only or {}).items() if v is not None}
    for c, v in chosen.items():
        df = df.where(F.col(c) == v)
    if strict or not chosen:
        df = df.where(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days))
    return df


def where_all(df: DataFrame, **equal) -> DataFrame:
    """Rows that fit every condition given; None and "all" stand for no condition."""
    for c, v in equal.items():
        if v is not None and v != "all":
            df = df.where(F.col(c) == v)
    return df


def search(df: DataFrame, keyword: str, columns: list[str], limit: int = 10) -> DataFrame:
    """Rows that hold the keyword, taken literally, in one of the columns; limit is held between 1 and 50."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(keyword)), F.lit(False))
    return df.where(hit).orderBy(columns[0]).limit(min(max(limit, 1), 50))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest `order` columns: one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest(df: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).limit(1).isEmpty()


def with_any(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in others."""
    return df.join(others.select(key), key, "left_semi")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def first_and_last(df: DataFrame, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n_rows"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def default_row(df: DataFrame, defaults: dict) -> DataFrame:
    """df, or one row of defaults if it has none."""
    one = df.sparkSession.range(1).select(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in defaults.items()])
    marked = one.join(df.limit(1).select(F.lit(True).alias("_some")), how="left")
    return df.unionByName(marked.where("_some IS NULL").drop("_some"), allowMissingColumns=True)
