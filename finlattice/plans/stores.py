"""Queries of the keyed store: orders before 1999 are stored, batches change them, each of them sent twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_folder
from ..sources import payloads, store
from .inputs import BARS, bars, table
from .registry import query

KEYS = ["customer", "day", "id"]


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """A dated record of each order, under its customer."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def changed(spark: SparkSession, sf: str, first: str, last: str, by: float) -> DataFrame:
    """Orders of some days with other prices, every fifth without a status."""
    rows = orders(spark, sf).where(F.col("day").between(first, last))
    return rows.withColumns({"status": F.when(F.col("id") % 5 != 0, "N"), "price": F.col("price") + by})


ORDERS = """o AS (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders),
s AS (SELECT * FROM o WHERE day < DATE '1999-01-01'),
b1 AS (SELECT customer, day, id, CASE WHEN id % 5 <> 0 THEN 'N' END AS status, price + 1 AS price FROM o WHERE day BETWEEN DATE '1998-07-01' AND DATE '1999-03-31'),
b2 AS (SELECT customer, day, id, CASE WHEN id % 5 <> 0 THEN 'N' END AS status, price + 2 AS price FROM o WHERE day BETWEEN DATE '1999-02-01' AND DATE '1999-06-30')"""


def _stored(spark: SparkSession, sf: str, buckets: int = 4, grain: str = "year") -> store.KeyedStore:
    return store.create(orders(spark, sf).where("day < '1999-01-01'"), scratch_folder(spark, "keyed-store"), KEYS, bucket_by=["customer"], date="day", buckets=buckets, grain=grain)


def _after(spark: SparkSession, sf: str, change: Callable) -> DataFrame:
    """The store after two batches, each of which arrives twice."""
    held = _stored(spark, sf)
    batches = changed(spark, sf, "1998-07-01", "1999-03-31", 1.0), changed(spark, sf, "1999-02-01", "1999-06-30", 2.0)
    for i in (0, 0, 1, 0, 1):
        change(held, f"batch {i}", batches[i])
    return store.open_store(spark, held.path).rows()


def _twice(step: str) -> str:
    """SQL of two steps: {old} and {new} are the tables that a step joins."""
    return f"WITH {ORDERS}, t1 AS ({step.format(old='s', new='b1')}), t2 AS ({step.format(old='t1', new='b2')}) SELECT * FROM t2"


_KEY = "customer, day, id"


@query(_twice(f"SELECT {_KEY}, CASE WHEN {{new}}.price IS NULL THEN {{old}}.status ELSE {{new}}.status END AS status, coalesce({{new}}.price, {{old}}.price) AS price FROM {{old}} FULL JOIN {{new}} USING ({_KEY})"))
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf, lambda held, name, rows: held.upsert(name, rows))


@query(_twice(f"SELECT {_KEY}, coalesce({{new}}.status, {{old}}.status) AS status, coalesce({{new}}.price, {{old}}.price) AS price FROM {{old}} FULL JOIN {{new}} USING ({_KEY})"))
def store_upsert_coalescing(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf, lambda held, name, rows: held.upsert(name, rows, coalesce=True))


@query(_twice(f"SELECT {_KEY}, CASE WHEN {{old}}.price IS NULL THEN {{new}}.status ELSE {{old}}.status END AS status, coalesce({{new}}.price, {{old}}.price) AS price FROM {{old}} FULL JOIN {{new}} USING ({_KEY})"))
def store_upsert_some_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf, lambda held, name, rows: held.upsert(name, rows, columns=["price"]))


@query(_twice(f"SELECT * FROM {{old}} UNION ALL SELECT * FROM {{new}} WHERE ({_KEY}) NOT IN (SELECT ({_KEY}) FROM {{old}})"))
def store_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf, lambda held, name, rows: held.insert_ignore(name, rows, "id"))


@query(_twice("SELECT * FROM {new} UNION ALL SELECT * FROM {old} WHERE customer NOT IN (SELECT customer FROM {new})"))
def store_replace_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders give way to those of the batch."""
    return _after(spark, sf, lambda held, name, rows: held.replace(name, rows))


@query(_twice(f"SELECT * FROM {{old}} WHERE ({_KEY}) NOT IN (SELECT ({_KEY}) FROM {{new}})"))
def store_delete(spark: SparkSession, sf: str) -> DataFrame:
    return _after(spark, sf, lambda held, name, rows: held.delete(name, rows.select(*KEYS)))


@query(f"WITH {ORDERS} SELECT * FROM s WHERE day >= DATE '1998-06-15' - 90")
def store_retain(spark: SparkSession, sf: str) -> DataFrame:
    held = _stored(spark, sf, buckets=2, grain="month")
    for as_of in ("1998-02-10", "1998-06-15", "1998-06-15"):
        held.retain_since(f"as of {as_of}", 90, as_of)
    return held.rows()


@query(f"WITH {ORDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY id DESC) AS k FROM s) SELECT customer, day, id, status, price FROM k WHERE k <= 2")
def store_keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's two newest orders, by id."""
    held = _stored(spark, sf)
    held.keep_latest("first", "id", 3)
    held.keep_latest("second", "id", 2)
    held.keep_latest("second", "id", 2)
    return held.rows()


@query(f"WITH {BARS} SELECT symbol, bar_date, open, high, low, close, volume FROM bars WHERE bar_date BETWEEN DATE '1996-03-01' AND DATE '1999-12-31'")
def payload_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as payload files of two places, read back through the data source, the dates clamped; the first place lacks some symbols."""
    spark.dataSource.register(payloads.PayloadSource)
    base, rows = scratch_folder(spark, "payloads"), bars(spark, sf).withColumn("name", F.translate("symbol", " ", "_"))
    record = F.struct("bar_date", "open", "high", "low", "close", "volume", F.col("symbol").alias("called"))
    texts = rows.groupBy("name").agg(F.to_json(F.array_sort(F.collect_list(record))).alias("value"))  # one symbol's history
    places = []
    for place, held in (("first", texts.where("name < '3'")), ("second", texts)):
        held.repartition("name").write.partitionBy("name").text(f"{base}/{place}")
        places.append(f"{base}/{place}")
    names = [r[0] for r in texts.select("name").distinct().collect()]  # a row a symbol
    source = spark.read.format("payloads").options(places=";".join(places), symbols=",".join(sorted(names)), file="name={symbol}", start="19960301", end="1999-12-31")
    found = source.schema("called string, bar_date date, open double, high double, low double, close double, volume double").load()
    return found.withColumnRenamed("called", "symbol")
