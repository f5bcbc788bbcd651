"""Readers: files with many spellings of the same columns, page payloads, JDBC, message logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import safe_date, safe_double

# The source tables' column names and ours.
COLUMN_NAMES = {
    "日期": "bar_date",
    "开盘": "open",
    "最高": "high",
    "最低": "low",
    "收盘": "close",
    "成交量": "volume",
    "成交额": "amount",
    "振幅": "amplitude",
    "涨跌幅": "change_pct",
    "涨跌额": "change_amt",
    "换手率": "turnover_rate",
}
# Other spellings that files use.
DATE_ALIASES = ("日期", "净值日期", "date", "Date", "bar_date", "nav_date")
NAV_ALIASES = ("净值", "nav", "NAV", "单位净值", "unit_nav")
CLOSE_ALIASES = ("收盘", "close", "Close", "close_price", "收盘价")
ACCUM_ALIASES = ("累计净值", "accum_nav")


def english(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: COLUMN_NAMES[c] for c in df.columns if c in COLUMN_NAMES})


def first_of(df: DataFrame, aliases: tuple[str, ...], what: str) -> Column:
    """The first column with one of the names; for dates, else the first whose name ends with _date."""
    for name in (*aliases, *(c for c in df.columns if what == "date" and c.endswith("_date"))):
        if name in df.columns:
            return F.col(f"`{name}`")
    raise ValueError(f"no {what} column among {df.columns}")


def _csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    df = spark.read.option("header", "true").option("encoding", encoding).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def read_bars_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Daily bars with English names; numbers and dates that can't be read become null, rows without a date go."""
    df = english(_csv(spark, path, encoding))
    kinds = {c: safe_date(F.col(c)) if c == "bar_date" else safe_double(F.col(c)) for c in df.columns if c in COLUMN_NAMES.values()}
    return df.withColumns(kinds).where(F.col("bar_date").isNotNull())


def read_nav_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    df = _csv(spark, path, encoding)
    accum = next((F.col(f"`{c}`") for c in ACCUM_ALIASES if c in df.columns), F.lit(None))
    return df.select(safe_date(first_of(df, DATE_ALIASES, "date")).alias("nav_date"), safe_double(first_of(df, NAV_ALIASES, "value")).alias("unit_nav"), safe_double(accum).alias("accum_nav")).where("nav_date IS NOT NULL")


def read_benchmark_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    df = _csv(spark, path, encoding)
    return df.select(safe_date(first_of(df, DATE_ALIASES, "date")).alias("bar_date"), safe_double(first_of(df, CLOSE_ALIASES, "close")).alias("close_price")).where("bar_date IS NOT NULL")


def nav_from_script(df: DataFrame, payload: str, variable: str = "Data_netWorthTrend") -> DataFrame:
    """Rows of a script payload's JSON list of {x: epoch ms, y: value}; values of 0 or null go."""
    items = F.from_json(F.regexp_extract(payload, rf"{variable}\s*=\s*(\[.*?\])\s*;", 1), "array<struct<x:bigint,y:double>>")
    rows = df.withColumn("_p", F.explode(items))
    return rows.select(*[c for c in df.columns if c != payload], F.to_date(F.timestamp_millis("_p.x")).alias("nav_date"), F.col("_p.y").alias("unit_nav")).where("unit_nav IS NOT NULL AND unit_nav <> 0")


def nav_from_table(df: DataFrame, payload: str) -> DataFrame:
    """Rows of an HTML table: the first cells of each row are date, value and accumulated value."""
    cells = F.regexp_extract_all(payload, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)
    rows = df.withColumn("_r", F.explode(cells)).withColumn("_c", F.regexp_extract_all("_r", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1))
    return rows.select(*[c for c in df.columns if c != payload], safe_date(F.get("_c", F.lit(0))).alias("nav_date"), safe_double(F.get("_c", F.lit(1))).alias("unit_nav"), safe_double(F.get("_c", F.lit(2))).alias("accum_nav")).where("nav_date IS NOT NULL")


def unpivot_dated(df: DataFrame, ids: list[str], suffix: str = "-单位净值") -> DataFrame:
    """Columns named yyyy-MM-dd and the suffix become rows of date and value."""
    dated = [c for c in df.columns if c.endswith(suffix)]
    long = df.unpivot(ids, [F.col(f"`{c}`").cast("string").alias(c) for c in dated], "_name", "_value")
    return long.select(*ids, safe_date(F.regexp_extract("_name", r"^(\d{4}-\d{2}-\d{2})", 1)).alias("nav_date"), safe_double(F.col("_value")).alias("unit_nav")).where("nav_date IS NOT NULL AND unit_nav IS NOT NULL")


def first_available(*sources: DataFrame) -> DataFrame:
    """The rows of the first source that has any."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int = 16, **options: str) -> DataFrame:
    """A table of a relational store, read in parallel ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options).load()


def message_fields(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Messages with their JSON payload parsed, and kept raw where it is none."""
    parsed = F.from_json(payload, schema)
    return df.withColumns({"fields": parsed, "raw": F.when(F.try_parse_json(F.col(payload)).isNull(), F.col(payload))})


def encode_message(*fields: str) -> Column:
    return F.to_json(F.struct(*fields))
